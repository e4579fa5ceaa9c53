"""The LSH forest against all pairs, dense regions, seams between tasks and odd rows."""

import collections
import itertools

import numpy as np
import pytest

from starledger.llm import minhash, queries

from .test_operators import DOCS, EDGE, SF, SF_MODEL, empty, odd, texts

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_set(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    words = [w for w in text.translate(UPPER).split(" ") if w]
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < 3 else frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def plain_components(rows):
    """(n_shingles, component) of every (doc_id, text): all pairs that share a shingle."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, s in enumerate(sets):
        root[i] = first.setdefault(s, i) if s else i
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    tried = set()
    for group in holders.values():
        distinct = list({sets[i]: i for i in group}.values())
        for a, b in itertools.combinations(distinct, 2):
            if (a, b) not in tried:
                tried.add((a, b))
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[top(b)] = top(a)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, len(s), least.get(top(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(df):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()]


@pytest.mark.parametrize("sf", [SF, SF_MODEL])
def test_stored_documents(spark, sf):
    got = queries.op12_minhash_forest(spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components([(r["doc_id"], r["text"]) for r in texts(sf=sf)]))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(rng, base, k, words, edits):
    """Copies of ``base`` with a few words changed each."""
    out = []
    for _ in range(k):
        copy = list(base)
        for at in rng.integers(0, len(copy), edits):
            copy[at] = str(rng.choice(words))
        out.append(" ".join(copy))
    return out


def test_dense_families(spark):
    """Hundreds of edits of one text, most of them near the text only, and thousands of texts with one long passage."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for length, edits in ((120, 2), (90, 2), (60, 1)):
        base = [str(w) for w in rng.choice(words, length)]
        rows += [" ".join(base), *family(rng, base, 150, words, edits)]
    passage = [str(w) for w in rng.choice(words, 80)]
    rows += [" ".join([*passage, *(str(w) for w in rng.choice(words, 60))]) for _ in range(200)]
    pair = [str(w) for w in rng.choice(words, 60)]
    rows += [" ".join([*passage, *pair]), " ".join([*passage, *pair[:-1], "other"])]
    order = rng.permutation(len(rows))
    docs = [(int(i), rows[j]) for i, j in enumerate(order)]
    df = spark.createDataFrame([(*d, "en", "s", 0) for d in docs], DOCS).repartition(7)
    assert sorted(found(minhash.near_duplicates(df))) == sorted(plain_components(docs))


def test_odd_documents(spark):
    """Null, empty and wordless texts are linked with nothing; texts of a word or two are sets of one."""
    huge = "".join(f"word{i} " for i in range(600_000))
    rows = [(10, huge), (11, huge + "more"), (12, "x" * 2_000_000), (13, "X" * 2_000_000 + " "), (14, "two words"), (15, "TWO\twords"), (16, "two word"), (None, "two words")]
    plain = [*EDGE, *rows]
    df = odd(spark.createDataFrame([(i, t, "en", None, 0) for i, t in plain], DOCS))
    assert sorted(found(minhash.near_duplicates(df)), key=repr) == sorted(plain_components(plain), key=repr)
    out = minhash.near_duplicates(empty(spark))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_neighbours_over_many_tasks(spark):
    """Each set meets its neighbours in every order however the ranges are cut."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = [str(w) for w in rng.choice(words, 100)]
    rows = family(rng, base, 40, words, 1)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], DOCS)
    distinct = minhash.per_batch(minhash._documents(df), minhash._sketch_kernel, "doc_id bigint, mark bigint, n bigint, node binary, paths binary").select("node", "n", "paths")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    counts = []
    for parts, adaptive in (("1", "false"), ("40", "false")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            counts.append(minhash.forest(distinct)[0].count())
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", before)
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert counts[1] >= 0.95 * counts[0] > 200  # more where a task does not see how dense its ends are


def test_candidates_grow_with_the_sets(spark):
    """Twice the copies, twice the candidates: no pairs of a whole group."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = [str(w) for w in rng.choice(words, 100)]
    sizes = []
    for k in (150, 600):
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(family(rng, base, k, words, 2))], DOCS)
        distinct = minhash.per_batch(minhash._documents(df), minhash._sketch_kernel, "doc_id bigint, mark bigint, n bigint, node binary, paths binary").select("node", "n", "paths")
        sizes.append(minhash.forest(distinct)[0].count())
    assert sizes[1] <= 600 * minhash.TREES * minhash.NEIGHBOURS and sizes[1] < 8 * sizes[0]


def test_pairs_asked_in_a_crowded_region(spark, monkeypatch):
    """Twice the edits of one text that few and many words set apart: no pairs of those outside its component with all within."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    base = [str(w) for w in rng.choice(words, 150)]
    asked, linked = [], minhash._linked
    monkeypatch.setattr(minhash, "_linked", lambda pairs, sets: (asked.append(pairs.count()), linked(pairs, sets))[1])
    totals = []
    for k in (150, 300):
        rows = [" ".join(base), *family(rng, base, k, words, 3), *family(rng, base, k, words, 7)]
        edge = family(rng, base, 5, words, 4)
        rows += [*edge, *(family(rng, e.split(), 1, words, 3)[0] for e in edge)]  # further from the text than a link allows, linked to one edit of it
        docs = list(enumerate(rows))
        asked.clear()
        assert sorted(found(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)))) == sorted(plain_components(docs))
        totals.append(sum(asked))
    assert totals[1] < 3 * totals[0] and totals[1] < 300 * 300 / 2


def test_differences_by_brute_force(spark):
    """Every link of a set that is not linked to the centre is among the pairs, whatever the sets' sizes and where they differ."""
    rng = np.random.default_rng(9)
    middle = frozenset(range(40))

    def changed(s, out, more, pool):
        return frozenset(s) - set(rng.choice(sorted(s), out, replace=False).tolist()) | set(rng.choice(pool, more).tolist())

    def alike(a, b):
        return 100 * len(a & b) >= 85 * len(a | b)

    within = [middle, *(changed(middle, rng.integers(0, 6), rng.integers(0, 8), np.arange(40, 55)) for _ in range(150))]
    beside = [changed(within[i], rng.integers(0, 5), rng.integers(0, 5), np.arange(40, 60)) for i in rng.integers(0, 150, 150)]
    node = {s: i.to_bytes(4) for i, s in enumerate(dict.fromkeys([*within, *beside]))}
    beside = [s for s in beside if s not in set(within)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    sets = frame([(bytearray(i), sorted(s)) for s, i in node.items()], "node binary, shingles array<bigint>")
    inside = list(dict.fromkeys(within))
    members = frame([(bytearray(b"r"), len(inside), bytearray(node[s]), sorted(s)) for s in inside], "root binary, members bigint, node binary, shingles array<bigint>")
    count = collections.Counter(x for s in inside for x in s)
    counts = frame([(bytearray(b"r"), len(inside), x, c) for x, c in count.items()], "root binary, members bigint, s bigint, count bigint")
    outside = frame([(bytearray(node[s]), bytearray(b"r")) for s in dict.fromkeys(beside)], "node binary, root binary")
    centres = frame([(bytearray(b"r"), bytearray(node[middle]), sorted(middle))], "root binary, centre binary, middle array<bigint>")
    got = {(bytes(r.a), bytes(r.b)) for r in minhash._by_differences(outside, members, sets, counts, centres).collect()}
    want = {(min(node[s], node[m]), max(node[s], node[m])) for s in beside if not alike(s, middle) for m in inside if alike(s, m)}
    assert len(want) > 50 and want <= got
    assert len(got) < len(set(beside)) * len(inside) / 3
