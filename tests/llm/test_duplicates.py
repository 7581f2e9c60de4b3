"""Exact, SimHash, repeated-string and fuzzy-line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlab.llm import common, exact, fuzzy_lines, repeats, simhash
from spanlab.llm.common import components

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    want = union(341, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


# exact

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_quotient_filters_merge_without_loss(a, b):
    a, b = a + a[:5] + b[:3], b + [0, 2**64 - 1]
    f = exact.QuotientFilter.of(np.array(a, np.uint64)).merge(exact.QuotientFilter.of(np.array(b, np.uint64)))
    got = dict(zip(f.fingerprints().tolist(), f.counts.tolist()))
    assert got == {x: (a + b).count(x) for x in set(a + b)}
    pieces = [exact.QuotientFilter.from_bytes(p) for _, p in f.pieces(4)]
    assert [x for p in pieces for x in p.fingerprints().tolist()] == f.fingerprints().tolist()


def test_exact_duplicates(odd_docs, no_docs):
    rows = odd_docs.collect()
    norm = [(r.text or "").encode().translate(LOW) for r in rows]
    got = sorted((r.text_sha256, r.group_size, r.keep_id or 0, r.kept, r.doc_id or 0)
                 for r in exact.exact_duplicates(odd_docs).collect())
    want = []
    for r, t in zip(rows, norm):
        same = [q.doc_id for q, u in zip(rows, norm) if u == t]
        keep = max((i for i in same if i is not None), default=None)
        want.append((hashlib.sha256(t).hexdigest(), len(same), keep or 0, r.doc_id == keep, r.doc_id or 0))
    assert got == sorted(want)
    assert exact.exact_duplicates(no_docs).collect() == []


# SimHash

@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.lists(st.integers(0, 63), max_size=6), min_size=1, max_size=70),
       st.integers(1, 5))
def test_bit_sliced_distances(query, flips, radius):
    fps = []
    for bits in flips:
        x = query
        for b in bits:
            x ^= 1 << b
        fps.append(x)
    found = simhash.within(query, simhash._planes(np.array(fps, np.uint64)), len(fps), radius)
    assert list(simhash._members(found)) == [i for i, x in enumerate(fps) if (x ^ query).bit_count() <= radius]


def test_links_over_tiles(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    at = {x: i for i, x in enumerate(signed)}
    for tile in (3, 2048):
        edges = simhash.links(table, 2, tile).collect()
        assert all((fps[at[e.a]] ^ fps[at[e.b]]).bit_count() <= 2 for e in edges)
        assert union(len(fps), [(at[e.a], at[e.b]) for e in edges]) == want


def brute_fingerprint(text):
    import xxhash
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    want = sorted((r.doc_id or 0, fps[i] - (1 << 64) if fps[i] >> 63 else fps[i],
                   min((q.doc_id for j, q in enumerate(rows) if root[j] == root[i] and q.doc_id is not None), default=0))
                  for i, r in enumerate(rows))
    got = sorted((r.doc_id or 0, r.fp, r.component or 0) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == want
    assert simhash.near_duplicates(no_docs).collect() == []


# repeated strings

def brute_repeats(docs, length):
    """docs: [(doc_id, bytes)] by ascending doc_id -> removed flags."""
    seen, out = {}, []
    for i, t in docs:
        flags = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            if w in seen and seen[w] != (i, p):
                flags[p:p + length] = b"\1" * length
            seen.setdefault(w, (i, p))
        out.append(flags)
    return out


def check_repeats(spark, docs, length, gram, columns=None):
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, length, gram).collect()}
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    for (i, t), flags in zip(rows, brute_repeats(rows, length)):
        assert got[i].n_bytes == len(t)
        assert bytes(got[i].kept) == bytes(c for c, f in zip(t, flags) if not f), i
        assert sum(s.stop - s.start for s in got[i].spans) == sum(flags)
        assert all(a.stop < b.start for a, b in zip(got[i].spans, got[i].spans[1:]))


def made_up(seed, n):
    rng = random.Random(seed)
    def text(k): return "".join(rng.choice("abcé ") for _ in range(k))
    passages = [text(rng.randrange(10, 90)) for _ in range(5)]
    rows = []
    for i in range(n):
        rows.append((i * 3, "".join(rng.choice(passages) if rng.random() < 0.5 else text(rng.randrange(30)) for _ in range(6))))
    return [*rows, (1000, "a" * 300), (1001, "ab" * 200), (1002, None), (1003, ""), (1004, rows[0][1])]


def test_repeats_brute_force(spark):
    docs = spark.createDataFrame(made_up(1, 60), "doc_id long, text string").repartition(5)
    check_repeats(spark, docs, 20, 6)


def test_repeats_of_outgrown_anchors(spark, monkeypatch):
    for name, value in (("GROUP", 2), ("HOT_ROWS", 6), ("LOCAL", 2), ("SLICE", 64), ("SORT_BYTES", 500)):
        monkeypatch.setattr(repeats, name, value)
    docs = spark.createDataFrame(made_up(2, 60), "doc_id long, text string").repartition(3)
    check_repeats(spark, docs, 20, 6)


def test_repeat_groups_have_all_occurrences():
    strings = [b"xxabcdefyy", b"zzabcdefyw", b"qabcdefq", b"abc"]
    group = np.zeros(4, np.int64)
    rank = np.stack([np.arange(4), np.zeros(4, np.int64)], axis=1)
    strings = strings[:3]
    found = {(n, strings[m[0][0]][m[0][1]:m[0][1] + n]): sorted(m)
             for n, m in repeats.repeat_groups(strings, group[:3], rank[:3], 4)}
    assert found == {(6, b"abcdef"): [(0, 2), (1, 2), (2, 1)], (7, b"abcdefy"): [(0, 2), (1, 2)]}


def test_repeats_odd_documents(odd_docs, no_docs):
    out = repeats.remove_repeats(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r.n_bytes == 0 and r.kept == b"" for r in out if r.doc_id in (3, 4))
    assert repeats.remove_repeats(no_docs).collect() == []
    # the null id is the smallest; the two rows of document 2 are one document
    long_base = [r for r in out if r.doc_id == 7][0]
    assert len(long_base.kept) < 200


# lines

def grams(line, k=fuzzy_lines.SHINGLE):
    b = line.encode()
    return frozenset(b[i:i + k] for i in range(max(len(b) - k + 1, 1)))


def brute_lines(rows):
    """[(doc_id, text)] by doc_id -> kept texts, with every linked pair found."""
    first = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, p))
    names = list(first)
    sets = [grams(x) for x in names]
    root = union(len(names), [(i, j) for i in range(len(names)) for j in range(i)
                              if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= fuzzy_lines.THRESHOLD])
    stays = {}
    for n, r in zip(names, root):
        stays[r] = min(stays.get(r, first[n]), first[n])
    of = dict(zip(names, root))
    return [None if t is None else "\n".join(
        line for p, line in enumerate(t.split("\n")) if not line.strip(" ") or stays[of[line]] == (i, p)) for i, t in rows]


def test_lines_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    def words(n): return [("%x" % rng.getrandbits(20)) for _ in range(n)]
    base = [words(30) for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(6):
            w = list(rng.choice(base))
            if rng.random() < 0.7:
                w[rng.randrange(30)] = words(1)[0]
            lines.append(" ".join(w))
        rows.append((d, "\n".join([*lines, "", "short", "é" * 30])))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_lines(rows)
    for limit in (fuzzy_lines.ROW_BYTES, 50):  # in one row, and by a join
        monkeypatch.setattr(fuzzy_lines, "ROW_BYTES", limit)
        got = {r.doc_id: r for r in fuzzy_lines.dedup_lines(docs).collect()}
        assert [got[i].text for i, _ in rows] == want
    assert got[100].n_lines == 0 and got[102].n_lines == 3 and got[103].n_dropped >= 7


def test_hot_line_buckets(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "HOT_ROWS", 3)
    rng = random.Random(4)
    base = ["%x" % rng.getrandbits(24) for _ in range(40)]
    rows = []
    for d in range(30):
        w = list(base)
        w[rng.randrange(40)] = "%x" % rng.getrandbits(24)
        rows.append((d, " ".join(w)))
    got = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows)


def test_edits_of_ordinary_lines(spark, monkeypatch):
    k, rng = 5, random.Random(12)  # shingles of five characters, whatever the module has
    def word(): return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    def han(n): return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    pairs = []
    for size in range(40, 101):
        line = " ".join(word() for _ in range(40))[:size]
        at = rng.randrange(10, size - 10)
        pairs.append((line, line[:at] + "Z" + line[at + 1:]))
        w = line.split(" ")
        w[rng.randrange(len(w))] = word().upper()
        pairs.append((line.upper(), " ".join(w).upper()))
        line = han(size - 1) + "\U0001F600"
        pairs.append((line, line[:at] + han(1) + line[at + 1:]))
    pairs += [("tiny", "tinx"), ("abcdef", "abcdeg")]
    def shingles(t): return {t[i:i + k] for i in range(max(len(t) - k + 1, 1))}
    def jaccard(a, b): return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    near = [jaccard(a, b) >= 0.8 for a, b in pairs]
    docs = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    for limit in (fuzzy_lines.ROW_BYTES, 60):
        monkeypatch.setattr(fuzzy_lines, "ROW_BYTES", limit)
        gone = {r.doc_id for r in fuzzy_lines.dedup_lines(docs).where("n_dropped > 0").collect()}
        found = [2 * i + 1 in gone for i in range(len(pairs))]
        assert sum(near) > 120 and not any(i % 2 == 0 for i in gone)
        assert not any(f and not n for f, n in zip(found, near))
        assert sum(found) >= 0.97 * sum(near)


def test_recall_of_short_lines(spark):
    rng = random.Random(13)
    pairs = []
    for i in range(1000):  # Jaccard 0.8: 8 of 10 and 16 of 20 shingles of five characters in common
        line = "".join(rng.choice("abcdefghijklmnop") for _ in range(22 if i % 2 else 13))
        pairs.append((line, ("Z" if i % 2 else line[0]) + line[1:-1] + "Z"))
    docs = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    gone = {r.doc_id for r in fuzzy_lines.dedup_lines(docs).where("n_dropped > 0").collect()}
    for kind in (0, 1):
        assert sum(2 * i + 1 in gone for i in range(kind, 1000, 2)) >= 480


def test_wide_tables_are_not_broadcast(spark, monkeypatch):
    def hinted(df): return "ResolvedHint" in common.small(df)._jdf.queryExecution().analyzed().toString()
    numbers, names = "sequence(1, 1000000) gone", "array('a', repeat('b', 3000000)) items"
    assert hinted(spark.range(20))
    for column in (numbers, names):
        assert hinted(spark.range(2).selectExpr("id", column))
        assert not hinted(spark.range(20).selectExpr("id", column))
    docs = spark.createDataFrame([(1, "a line\nanother"), (2, "a line\nits own"), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert got == {1: "a line\nanother", 2: "its own", 3: None}


def test_lines_native(spark, odd_docs, no_docs):
    out = fuzzy_lines.dedup_lines(odd_docs)
    assert set(odd_docs.columns) <= set(out.columns)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert all(r.text is None and r.n_lines == 0 for r in rows if r.doc_id == 3)
    # the null id comes first, so its line is the one that stays
    assert [r.text for r in rows if r.doc_id == 1] == [""]
    assert fuzzy_lines.dedup_lines(no_docs).collect() == []
