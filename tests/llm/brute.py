"""Plain versions of the operators, without Spark."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(lower_ascii(text))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def near_components(docs, percent=85):
    """doc_id → smallest doc_id that links reach."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def repeated_words(docs, length=50):
    """(repeat, cut): word numbers by doc_id in passages that occur twice, and in those that occur before."""
    places = defaultdict(list)
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - length + 1):
            places[tuple(w[k:k + length])].append((i, k))
    repeat, cut = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                repeat[i].update(range(k, k + length))
                if (i, k) != min(found):
                    cut[i].update(range(k, k + length))
    return repeat, cut


def stretches(numbers):
    out = []
    for n in sorted(numbers):
        if out and out[-1][1] == n:
            out[-1][1] = n + 1
        else:
            out.append([n, n + 1])
    return [tuple(x) for x in out]


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def greedy_pieces(word, initial, inner):
    """Longest-match-first pieces of a word; None if it cannot be cut."""
    out, at = 0, 0
    while at < len(word):
        vocabulary = initial if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return None
        out, at = out + 1, end
    return out


def smallest_capacity(sizes, shards):
    """Smallest largest part of a contiguous partition, by dynamic programming."""
    best = [0] + [sum(sizes[:i + 1]) for i in range(len(sizes))]
    for _ in range(shards - 1):
        best = [0] + [min(max(best[j], sum(sizes[j:i + 1])) for j in range(i + 1)) for i in range(len(sizes))]
    return best[-1]


def fingerprint(text):
    """SimHash of the three-word shingles, bit by bit."""
    w = words(lower_ascii(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprint_components(prints, distance=2):
    """doc_id → smallest doc_id that links between fingerprints reach; prints: (doc_id, fingerprint)."""
    nodes = sorted({f for _, f in prints})
    left, group = set(nodes), {}
    while left:
        reached = todo = {left.pop()}
        while todo:
            todo = {y for y in left for x in todo if (x ^ y).bit_count() <= distance}
            left -= todo
            reached = reached | todo
        low = min(i for i, f in prints if f in reached)
        group |= dict.fromkeys(reached, low)
    return {i: group[f] for i, f in prints}


def runs(w, exponent=4, shortest=6):
    """(start, length, period) of every run, by start, then period."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, exponent * q) and not any(
                    all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    dropped = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def periodic_tail(doc_id, text):
    """The words with the periodic tail that the id asks for."""
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error)} and the digest of the codebooks; rows: (vec_id, vector)."""
    whole = [[math.floor(256 * x) for x in v] for _, v in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    ids = sorted({i for i, _ in rows})[:entries]
    first = [min(whole[n] for n, r in enumerate(rows) if r[0] == i) for i in ids]
    books = [[v[p * width:(p + 1) * width] for v in first] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(v)] for v in cut]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {n: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for n, f in enumerate(assigned())}, digest


def measured(text):
    """The measures of the quality rules, and whether the base rules fail."""
    n_words, chars, symbols, dup_lines, repeated = base_counts(text)
    uppers, bangs = len(re.findall("[A-ZÀ-ÖØ-Þ]", text or "")), (text or "").count("!")
    values = {"symbol_share": symbols / max(chars, 1), "repeat_share": repeated / max(n_words, 1), "dup_lines": float(dup_lines),
              "upper_share": uppers / max(chars, 1), "bang_share": bangs / max(n_words, 1)}
    return values, n_words < 50 or 100 * repeated > 50 * n_words


def joint_rules(docs, labels, grids, risk=0.05, failure=0.05, weight=20):
    """{stratum: {rule: cutoff}} of the certified joint rules; docs: (doc_id, text, stratum), labels: (doc_id, quality)."""
    quality = {}
    for i, q in labels:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, q))
    rows = defaultdict(list)
    for i, text, stratum in docs:
        values, fails = measured(text)
        if not fails and stratum is not None and i in quality:
            rows[stratum].append((values, quality[i] == 0, zlib.crc32(str(i).encode()) % 2))

    def gain(hit):
        return sum(1 if bad else -weight for bad in hit)

    joint = {}
    for stratum, own in rows.items():
        fit = [(v, bad) for v, bad, half in own if half == 0]
        best = []
        for place, (rule, cuts) in enumerate(grids.items()):
            found = [(gain(bad for v, bad in fit if v[rule] > c), number) for number, c in enumerate(cuts)]
            if max(found)[0] > 0:
                best.append((-max(found)[0], place, rule, max(found)[1]))
        left, kept = fit, {}
        for _, _, rule, number in sorted(best):
            hit = [bad for v, bad in left if v[rule] > grids[rule][number]]
            left = [(v, bad) for v, bad in left if v[rule] <= grids[rule][number]]
            if gain(hit) > 0:
                kept[rule] = number
        if kept:
            joint[stratum] = kept
    out = {}
    for stratum, kept in joint.items():
        good = [v for v, bad, half in rows[stratum] if half == 1 and not bad]
        levels = []
        for level in range(max(map(len, grids.values()))):
            cuts = {rule: grids[rule][n + level] for rule, n in kept.items() if n + level < len(grids[rule])}

            def rejects(v):
                return any(v[rule] > c for rule, c in cuts.items())

            wrong = sum(map(rejects, good))
            tail = math.fsum(math.comb(len(good), k) * risk**k * (1 - risk) ** (len(good) - k) for k in range(wrong + 1))
            gained = gain(bad for v, bad, half in rows[stratum] if half == 0 and rejects(v))
            if wrong <= len(good) * risk and tail <= failure / len(joint) and gained > 0:
                levels.append((-gained, level, cuts))
        if levels:
            out[stratum] = min(levels, key=lambda x: x[:2])[2]
    return out
