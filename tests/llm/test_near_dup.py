import itertools
import random
import re
from difflib import SequenceMatcher

import duckdb
import numpy as np

from watchwell.llm import near_dup


def brute_classes(rows, threshold=0.8):
    """Components of all pairs that are similar, without sketches or bounds."""
    by_id = {}
    for d, t in rows:
        if d is not None:
            by_id.setdefault(d, []).append(near_dup.shingles(t))
    ids = sorted(by_id)
    parent = {d: d for d in ids}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(near_dup.similarity(x, y, threshold) for x in by_id[a] for y in by_id[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: find(d) for d in ids}


def aligned(a, b):
    """Length of the longest common subsequence of words, in full."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def test_similarity_is_that_of_aligned_words():
    rng = random.Random(8)
    for _ in range(60):
        n, kinds = rng.randint(20, 120), rng.choice([5, 60, 4000])
        a = [f"w{rng.randrange(kinds)}" for _ in range(n)]
        b, edits = list(a), rng.randint(0, 5)
        for _ in range(edits):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], ["new"], [b[at], "put"]])
        found = near_dup.similarity(near_dup.shingles(" ".join(a)), near_dup.shingles(" ".join(b)))
        most = aligned(a, b)
        if found:
            assert most - 4 * (edits + 1) <= round(found * max(len(a), len(b))) <= most
        else:
            assert most - 4 * (edits + 1) < 0.8 * max(len(a), len(b)) or edits * 5 > 0.4 * n


def corpus():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passage = [], text(55)
    for k in range(12):
        base = text(rng.randint(60, 160))
        rows.append(base)
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
        rows.append(base[60:] + base[:60])
        rows.append(text(30) + passage + text(40 + k))
    docs = [(i * 3 + 1, " ".join(w)) for i, w in enumerate(rows)]
    return docs + [(900, ""), (901, None), (902, "two words"), (903, "Two WORDS!"), (904, docs[0][1].upper()), (None, docs[0][1]), (None, ""), (905, "same same same same same same same"), (906, "same same same same same same")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, label int").repartition(3)
    got = near_dup.classes(df).collect()
    assert len(got) == len(rows)
    want, found = brute_classes(rows), {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert set(found) == set(want) and all(want[d] == want[c] and c <= d for d, c in found.items())  # no link is made up
    assert sum(found[d] == c for d, c in want.items()) >= 0.95 * len(want)
    surest = {d: [near_dup.shingles(t) for i, t in rows if i == d] for d in want}
    for a, b in itertools.combinations(sorted(surest), 2):
        for x, y in itertools.product(surest[a], surest[b]):
            if near_dup.similarity(x, y) and len(np.intersect1d(x, y)) > 0.83 * max(len(x), len(y)):
                assert found[a] == found[b]
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]
    kept = near_dup.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(found.values()))


def test_shared_ids_and_empty(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, a), (9, b), (9, b), (7, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in near_dup.classes(df).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3), (9, 3)]
    assert sorted(r.doc_id for r in near_dup.representatives(df).collect()) == [3, 7]
    assert near_dup.classes(df.limit(0)).collect() == []


def test_similarity_by_hand():
    a = near_dup.shingles(" ".join(f"w{i}" for i in range(104)))
    b = near_dup.shingles(" ".join("x" if i in (50, 70) else f"w{i}" for i in range(104)))
    assert near_dup.similarity(a, b) == 102 / 104
    assert near_dup.similarity(a, a) == 1
    assert near_dup.similarity(a, a[:79]) == 0
    assert near_dup.similarity(a, np.concatenate([a[50:], a[:50]])) == 0


def test_near_copies_by_words_are_found(spark):
    """Of all pairs of sf0.01 whose words align to 0.85 or more, nine of ten and more are in one class; others stay apart."""
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = list({(t or "").lower(): d for d, t in duckdb.sql(f"select doc_id, text from '{path}' order by doc_id desc").fetchall()}.items())
    words = [re.findall(r"\w+", t) for t, _ in texts]
    sets = [set(zip(w, w[1:], w[2:])) for w in words]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.read.parquet(path)).collect()}
    order = sorted((i for i in range(len(words)) if 20 <= len(words[i]) <= 1500), key=lambda i: len(words[i]))
    near, missed, apart = 0, 0, 0
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if len(words[j]) > 1.2 * len(words[i]):
                break
            if len(sets[i] & sets[j]) < 0.3 * max(len(sets[i]), len(sets[j])):
                apart += got[texts[i][1]] == got[texts[j][1]]
            elif SequenceMatcher(None, words[i], words[j], autojunk=False).ratio() >= 0.85:
                near += 1
                missed += got[texts[i][1]] != got[texts[j][1]]
    assert near > 40 and missed <= 0.1 * near and apart == 0


def test_all_links_of_the_given_documents_are_found(spark):
    """Recall against all links of sf0.01, of which sketches may miss few, and no link is made up."""
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}' order by doc_id").fetchall()
    made = [s for _, t in rows for s in [near_dup.shingles(t)]]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(made[i]))
    links = []
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if len(made[j]) > 1.25 * len(made[i]) + 2:
                break
            if near_dup.similarity(made[i], made[j]):
                links.append((rows[i][0], rows[j][0]))
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert len(links) > 100
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.read.parquet(path)).collect()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    whole = {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}
    assert all(whole[d] == whole[c] for d, c in got.items())


def test_hashes_and_bounds():
    texts = ["", "Zwölf Boxkämpfer jagen_1 Viktor, quer über den Sylter Deich", "a-b", "İstanbul ǅ", "x" * 70_000 + " y x", "y"]
    lower = [t.lower() for t in texts]
    units, at = near_dup.W.code_points(lower)
    starts, ends, first = near_dup.W.spans(units, at, near_dup.W.word_points())
    words = [re.findall(r"\w+", t) for t in lower]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat, hashes = [w for ws in words for w in ws], near_dup.W.hashes(units, starts, ends).tolist()
    assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))
    rng = random.Random(3)
    for n in (30, 200, 900):  # differing bits are never more than differing shingles
        a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        b = [w if rng.random() < 0.98 else "new" + w for w in a]
        x, y = (near_dup.shingles(" ".join(t)) for t in (a, b))
        bits = sum(int(v).bit_count() for v in (near_dup.signature(x) ^ near_dup.signature(y)).view(np.uint64))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_texts_around_a_passage_are_not_paired(spark, monkeypatch):
    """A passage of 0.76 of each text, the same few words beside it: pairs pass the bounds on words, but no text is covered."""
    rng, made, turn = random.Random(2), [], near_dup._turn
    passage, few = [f"p{i}" for i in range(312)], [f"w{i}" for i in range(20)]
    texts = [[*passage, *(rng.choice(few) for _ in range(100))] for _ in range(60)]
    # Linked to text 7 by way of one between them, and two that only their covers tell apart.
    texts += [[*texts[7][:350], "new", *texts[7][350:]], [*texts[7][:350], "new", *texts[7][350:], *passage[:30]], [*passage, *texts[9][312:350], *texts[3][312:350]]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]

    def counted(*given):
        pairs, left = turn(*given)
        made.append(pairs.count())
        return pairs, left

    monkeypatch.setattr(near_dup, "_turn", counted)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and len(set(want.values())) < len(rows)
    assert sum(made) < 200  # of 1,953


def test_shingles_of_near_copies_are_laid_out_once(spark, monkeypatch):
    """Covers are those of brute force, and neither copies nor a common passage make a row for each shingle of each text."""
    rng = random.Random(4)
    base, passage, few = ([f"{c}{i}" for i in range(300)] for c in "bpf")
    texts = [base[:i] + ["new"] + base[i:] for i in range(1, 300, 6)]
    texts += [[*passage, *(rng.choice(few) for _ in range(60))] for _ in range(30)]
    texts += [["two", "words"], base[:4], few[:5], few[:6], base[50:120], [*base[10:60], *passage[40:90], *base[9:14]], ["same"] * 40, ["same"] * 70]
    labels = [0] * 50 + list(range(50, len(texts)))
    lists = [near_dup.shingles(" ".join(t)) for t in texts]
    holders = {}
    for s, label in zip(lists, labels, strict=True):
        for x in s.tolist():
            holders.setdefault(x, set()).add(label)
    want = {}
    for node, s in enumerate(lists):
        at = [i for i, x in enumerate(s.tolist()) if len(holders[x]) > 1]
        if at:
            want[node] = near_dup.K + int(np.minimum(near_dup.K, np.diff(at)).sum())
    members = spark.createDataFrame([(i, 1, labels[i], len(s)) for i, s in enumerate(lists)], "node long, key long, label long, n int")
    given = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    made, kind = spark.sparkContext.accumulator(0), type(given)
    plain = kind.mapInPandas

    def counted(frame, run, *rest):
        def again(batches):
            for batch in run(batches):
                made.add(len(batch))
                yield batch

        return plain(frame, again, *rest)

    monkeypatch.setattr(kind, "mapInPandas", counted)
    got = {r.node: r.cover for r in near_dup._covered(members, given, 0.0).collect()}
    assert got == want
    whole = sum(map(len, lists))
    assert 0 < made.value < whole / 4  # before: all of them
    assert near_dup._placed(near_dup._stretched(members, given)).count() < whole / 2
