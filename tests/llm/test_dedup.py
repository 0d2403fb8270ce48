from __future__ import annotations

import random
import re

from siftwork.llm import line_dedup, near_dedup

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_groups(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}


def family(r: random.Random, n: int, size: int, edits: int) -> list[str]:
    base = prose(r, size, 5000).split()
    out = []
    for _ in range(n):
        words = base.copy()
        for _ in range(r.randrange(edits + 1)):
            words[r.randrange(size)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_groups_against_brute_force(spark):
    r = random.Random(5)
    texts = [prose(r, r.randrange(0, 120), 3000) for _ in range(60)]
    # a crowded family, some of whose members link only through others; smaller ones; copies; short texts
    texts += family(r, 120, 150, 4) + family(r, 10, 60, 1) + family(r, 6, 400, 8) + [texts[3]] * 3 + ["one two", "One  two", "one", "", "   "]
    # a crowded family under the limit: each member has a fifth of its words for itself, some share them with one other
    base = prose(r, 200, 10**6).split()
    for k in range(90):
        own = [f"own{k}x{i}" for i in range(30)]
        texts.append(" ".join(base + own))
        if k % 6 == 0:
            texts.append(" ".join(base + own[:-3] + [f"other{k}"]))
    r.shuffle(texts)
    rows = list(enumerate(texts, 100))
    got = {x["doc_id"]: x for x in near_dedup.group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: x["component_id"] for k, x in got.items()} == brute_groups(rows)
    assert all(x["kept"] == (k == x["component_id"]) and x["n_shingles"] == len(shingles(dict(rows)[k])) for k, x in got.items())


def test_near_awkward(spark, awkward, nothing):
    got = near_dedup.group(awkward).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by_id[4]["component_id"] == by_id[5]["component_id"] == 4 and by_id[None]["kept"] and by_id[None]["component_id"] is None and by_id[2]["n_shingles"] == 0
    left = near_dedup.keep_first(awkward)
    assert left.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 10]
    assert near_dedup.group(nothing).count() == 0 and near_dedup.keep_first(nothing).count() == 0


def normal(line: str) -> str:
    return re.sub(r"[^\w]+|_", " ", line.lower()).strip()


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark):
    r = random.Random(6)
    lines = [prose(r, 14, 900) for _ in range(80)]
    near = [lines[0] + "!", lines[1].upper(), "  " + lines[2].replace(" ", ", "), lines[3][:-1] + "q"]
    docs = [(k, "\n".join([*lines[4 * k : 4 * k + 4], "short line", ""])) for k in range(20)]
    docs += [(30, "\n".join(near[:2])), (31, "\n".join([*near[2:], "short line", "own line of this document, and long enough"])), (32, lines[10])]
    # a crowded bucket of alike lines
    base = prose(r, 30, 900)
    alike = [(100 + k, base[:-3] + f" {k:02d}") for k in range(60)] + [(200 + k, base) for k in range(50)]
    frame = spark.createDataFrame([(*d, len(d[1]), "x") for d in docs + alike], "doc_id bigint, text string, n_chars int, h string")
    got = {x["doc_id"]: x for x in line_dedup.deduplicate(frame).collect()}
    assert got[30]["emptied"] and got[30]["n_removed"] == 2 and got[32]["emptied"] and got[32]["text"] == "" and got[32]["n_chars"] == 0
    # short lines go by equality: all but the first document's
    assert "short line" in got[0]["text"] and "short line" not in got[31]["text"] and "own line" in got[31]["text"] and got[31]["n_removed"] == 3
    for k, text in docs[:20]:
        assert got[k]["text"] == (text if k == 0 else text.replace("short line\n", "")) and got[k]["n_removed"] == (k > 0) and got[k]["h"] == "x"
    assert [k for k, _ in alike if not got[k]["emptied"]] == [100]
    # whatever went has a similar line left
    kept = [normal(x) for g in got.values() for x in g["text"].split("\n")]
    for k, text in docs[20:]:
        for line in set(text.split("\n")) - set(got[k]["text"].split("\n")):
            n = normal(line)
            assert any(edits(n, other) <= (1 - line_dedup.SIMILAR) * max(len(n), len(other)) + 1e-9 for other in kept)


def within(a: str, b: str, limit: int) -> bool:
    """At most `limit` edits; only cells near the diagonal, and no further once all are beyond it."""
    row = {j: j for j in range(min(len(b), limit) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            row[j] = i if j == 0 else min(last.get(j - 1, limit) + (x != b[j - 1]), last.get(j, limit) + 1, row.get(j - 1, limit) + 1)
        if min(row.values()) > limit:
            return False
    return row.get(len(b), limit + 1) <= limit


def brute_lines(rows: list[tuple[int, str]]) -> dict[tuple[int, int], int]:
    """Group number of every line with a normal form, by comparing all pairs."""
    at = [(k, i, n) for k, text in rows for i, line in enumerate(text.split("\n")) if (n := normal(line))]
    forms = sorted({n for *_, n in at})
    parent = {n: n for n in forms}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {n: {c: n.count(c) for c in set(n)} for n in forms}
    for i, a in enumerate(forms):
        for b in forms[i + 1 :]:
            limit = max(len(a), len(b)) // 10
            if min(len(a), len(b)) < line_dedup.FUZZY_CHARS or abs(len(a) - len(b)) > limit:
                continue
            if sum(abs(bags[a].get(c, 0) - bags[b].get(c, 0)) for c in bags[a] | bags[b]) <= 2 * limit and within(a, b, limit):
                parent[root(a)] = root(b)
    numbers: dict = {}
    return {(k, i): numbers.setdefault(root(n), len(numbers)) for k, i, n in at}


def test_lines_of_given_documents_against_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    groups = brute_lines(rows)
    first: dict = {}
    for place in sorted(groups):
        first.setdefault(groups[place], place)
    gone = {place for place, g in groups.items() if first[g] != place}
    got = {(r["doc_id"], r["pos"]) for r in line_dedup.removed(frame).collect()}
    assert got == gone and len(gone) > 100


def test_lines_awkward(spark, awkward, nothing):
    got = line_dedup.deduplicate(awkward)
    assert got.columns[: len(awkward.columns)] == awkward.columns
    rows = got.collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11 and by_id[2]["text"] is None and by_id[3]["text"] == "" and by_id[None]["text"] == "text without an id" and by_id[1]["n_removed"] == 0
    assert by_id[5]["emptied"] and not by_id[4]["emptied"]
    assert line_dedup.deduplicate(nothing).count() == 0
