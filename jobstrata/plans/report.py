"""The whole report: every section as a table, and one JSON document of them.

``build_report`` persists the counted frames once and lets all sections roll up from them.
``write_report`` saves each section in full as its own table.  The document nests the sections whose
size is bounded by years, periods, fixed vocabularies or a top list; the sections in ``OPEN_SECTIONS`` grow with
the data and are always named by their table, whatever their size.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata.functions.metrics import finite
from jobstrata.plans import language, profile, quality, structure, trends  # noqa: F401  (register sections)
from jobstrata.plans.inputs import PostingCubes
from jobstrata.plans.registry import SECTIONS

SCHEMA_VERSION = "3.0"
#: Sections with a row per place, company or period pair found in the data: tables of their own, never nested.
OPEN_SECTIONS = ("loc.flags_min20", "dq.place_names_as_company")


def build_report(cubes: PostingCubes, names=None, frames=(), folder: str = None) -> dict:
    """Section name → DataFrame over shared, persisted inputs (all, or the named frames; tokens in ``folder`` if given); call
    ``cubes.release()`` after use."""
    cubes.shared(*frames, folder=folder)
    return {name: SECTIONS[name](cubes) for name in (names or SECTIONS)}


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, in every double column."""
    return df.select(*[finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_report(sections: dict, path: str, at_once: int = 8) -> dict:
    """Save every section as Parquet and return the saved tables.

    Sections are small once the counted frames are held, so several are written at once to keep the cluster busy.
    """
    def write(entry):
        name, df = entry
        target = f"{path}/{name.replace('.', '/')}"
        without_nan(df).write.mode("overwrite").parquet(target)
        return name, df.sparkSession.read.schema(df.schema).parquet(target)

    with ThreadPoolExecutor(at_once) as pool:
        return dict(pool.map(write, sections.items()))


def section_path(name: str, names) -> str:
    """The JSON path of a section in the document of all `names`."""
    group, _, leaf = name.partition(".")
    if leaf:
        return f"$.{group}.{leaf}"
    return f"$.{group}.rows" if any(n.startswith(f"{group}.") for n in names) else f"$.{group}"


def report_document(sections: dict, separate=OPEN_SECTIONS) -> DataFrame:
    """One row: the JSON document of the saved sections.

    Sections named ``a.b`` are nested under ``a``.  A section in ``separate`` appears as ``{"table": name}``.
    """
    parts = None
    for name, df in sections.items():
        group, _, leaf = name.partition(".")
        if name in separate:
            body = df.sparkSession.range(1).select(F.to_json(F.struct(F.lit(name).alias("table"))).alias("body"))
        else:
            rows = F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
            body = df.agg(F.concat(F.lit("["), F.concat_ws(",", rows), F.lit("]")).alias("body"))
        one = body.select(F.lit(group).alias("grp"), F.lit(leaf).alias("leaf"), "body")
        parts = one if parts is None else parts.unionByName(one)

    def entry(key, value):
        return F.concat(F.lit('"'), key, F.lit('":'), value)

    def braces(entries):
        return F.concat(F.lit("{"), F.concat_ws(",", entries), F.lit("}"))

    leaves = F.array_sort(F.collect_list(F.when(F.col("leaf") != "", entry(F.col("leaf"), F.col("body")))))
    own = F.max(F.when(F.col("leaf") == "", F.col("body")))
    grouped = parts.groupBy("grp").agg(leaves.alias("leaves"), own.alias("own"))
    # a group that has a table of its own keeps it under "rows"
    nested = F.when(F.size("leaves") == 0, F.col("own")).when(
        F.col("own").isNull(), braces(F.col("leaves"))
    ).otherwise(braces(F.concat(F.array(entry(F.lit("rows"), F.col("own"))), F.col("leaves"))))
    version = entry(F.lit("schema_version"), F.lit(f'"{SCHEMA_VERSION}"'))
    groups = F.array_sort(F.collect_list(entry(F.col("grp"), nested)))
    return grouped.agg(braces(F.concat(F.array(version), groups)).alias("document"))
