import random
import zlib

from pyspark.sql import functions as F

from watchwell.llm import toxicity, urls


def test_url_parts_and_rules(spark):
    rules = dict((r, v) for v, r in urls.RULES)

    def want(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fits, key=len, default=None)

    texts = [
        None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "https://example.com/en/x?y=/fr/", "http://www.Example.com/en/", "http://xexample.com/en/", "http://b.net/es/#/fr/",
        "http://net/fr/1", "http://b.net/fr", "http://b.net?/es/", "http://h://x.com/", "http://É.com/A", "http://a.com:80/x", "http://evil.org/" + "a" * 5000, "http://x.example.com/en/é\n/z",
    ]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "page_id long, url string, host string")
    for r in urls.judge_urls(df).collect():
        assert (r.host, r.path, r.rule) == want(texts[r.page_id]), texts[r.page_id]
        assert r.verdict == rules[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0)).collect() == []


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(1)
    rows = [(f"http://s{i}.example.{'bad' if i % 2 else 'good'}/{'x/' * (i % 4)}{rng.randint(0, 99)}", i % 2) for i in range(400)]
    judge = urls.train(spark.createDataFrame(rows[:300], "url string, label int"))
    host, path = urls.parts(F.col("url"))
    got = judge(spark.createDataFrame(rows[300:], "url string, label int").withColumns({"host": host, "path": path})).collect()
    assert sum((r.method == "block") == bool(r.label) for r in got) >= 98


def test_held_out_hosts(spark):
    """Labels depend on path and suffix; a third of the hosts is never trained on, some suffixes say nothing."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        host, kind = rng.randrange(120), rng.randrange(4)
        suffix = ["bad", "good", "mixed", "mixed"][kind]
        path = rng.choice(["index.html", "a/b/c?x=1&y=2&z=3&id=" + str(rng.randrange(10**9))])
        label = int(suffix == "bad" or (suffix == "mixed" and "?" in path))
        rows.append((i, f"http://h{host}.site.{suffix}/{path}", label))
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    host, path = urls.parts(F.col("url"))
    new = F.pmod(F.xxhash64(host), F.lit(3)) == 0
    judge = urls.train(df.filter(~new).select("url", "label"))
    got = judge(df.filter(new).withColumns({"host": host, "path": path})).collect()
    assert len(got) > 200 and sum((r.method == "block") == bool(r.label) for r in got) > 0.97 * len(got)
    twice = urls.judge_urls(df.unionByName(df.filter("page_id < 5")).select("page_id", "url"), df.select("url", "label")).collect()
    assert len(twice) == 1505 and len({(r.page_id, r.verdict) for r in twice}) == 1500  # repeated rows


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcd",)], "t string")
    assert [r[0] for r in df.select(urls.entropy(F.col("t"))).collect()] == [0.0, 0.0, 1.0, 2.0]


def corpus(n=600):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "loser"]))
            words.insert(0, "muslims")
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    truth = dict(labels)
    assert all((got[i] >= 0.5) == bool(truth[i]) for i in got if i % 5 == 0)
    # "muslims" only ever stands in toxic texts, and still moves no score by itself.
    probe = spark.createDataFrame([(1, "w1 w2 w3"), (2, "muslims w1 w2 w3"), (3, "women w1 w2 w3")], "doc_id long, text string")
    a, b, c = (r.score for r in toxicity.score(probe, model).orderBy("doc_id").collect())
    assert max(a, b, c) < 0.5


def test_counterfactuals():
    swap = toxicity.swaps(toxicity.IDENTITY)
    assert toxicity.counterfactual("The WOMEN left. Gay or not!", swap) == "The men left. straight or not!"
    assert toxicity.counterfactual("plain text", swap).endswith(" plain text")
    assert "chri*" not in toxicity.words("christians", swap) and "word*" in toxicity.words("wordless", swap)


def test_the_regulariser_lowers_false_positives_on_neutral_mentions(spark):
    """Groups are mentioned in both classes, more often in toxic texts; insults are weak signs."""
    rng = random.Random(7)
    vocabulary, rows = [f"w{i}" for i in range(200)], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [rng.choice(vocabulary) for _ in range(rng.randint(4, 12))]
        if rng.random() < (0.85 if toxic else 0.15):
            words.insert(rng.randrange(len(words)), rng.choice(["muslims", "women", "juden"]))
        if toxic and rng.random() < 0.75:
            words.insert(rng.randrange(len(words)), rng.choice([f"slur{j}" for j in range(12)]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels, held = df.filter("doc_id % 4 <> 0").select("doc_id", "toxic"), df.filter("doc_id % 4 = 0")
    mentions = F.expr("text rlike 'muslims|women|juden'")

    def false_positives(swap_weight):
        model = toxicity.train(df, labels, swap_weight=swap_weight)
        found = toxicity.score(held, model).withColumn("hit", F.col("score") >= 0.5)
        neutral = found.filter(mentions & (F.col("toxic") == 0)).agg(F.sum(F.col("hit").cast("int")), F.count("*")).first()
        right = found.filter("toxic = 1 AND text LIKE '%slur%'").agg(F.avg(F.col("hit").cast("int"))).first()[0]
        return neutral[0] / neutral[1], right

    plain, regular = false_positives(0.0), false_positives(1.0)
    assert plain[0] > 0.25 and regular[0] < plain[0] / 2, (plain, regular)
    assert regular[1] > 0.8


def test_empty_table_and_very_long_text(spark):
    docs, labels = corpus(200)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    assert toxicity.score(d.limit(0), model).collect() == []
    assert toxicity.score(d, toxicity.train(d.limit(0), y)).select("score").distinct().collect()[0].score == 0
    long = spark.createDataFrame([(1, "w1 " * 400_000 + "scum")], "doc_id long, text string")
    assert toxicity.score(long, model).collect()[0].score > toxicity.score(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), model).collect()[0].score


def test_query_and_edges(spark, tmp_path):
    docs, labels = corpus(200)
    extra = [(None, "no id"), (3, "again"), (900, None), (901, "")]
    spark.createDataFrame([(*r, "x", 0.5) for r in docs + extra], "doc_id long, text string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 204
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.score for r in toxicity.score(d, toxicity.train(d, none)).collect()} == {0.0}
