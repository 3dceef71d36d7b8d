"""Report sections by name.  Each is a function of (PostingCubes) returning a DataFrame."""

SECTIONS = {}


def section(name: str):
    def add(fn):
        SECTIONS[name] = fn
        return fn

    return add
