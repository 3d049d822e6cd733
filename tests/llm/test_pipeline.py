import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_quality import brute as brute_statistics
from test_quality import walk
from test_simhash import brute_components, brute_print
from test_toxicity import brute_score
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import exact_dedup, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "exact dedup", "SimHash near-dedup", "best-fit packing"]


def test_each_stage_keeps_what_it_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        made = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert made.columns == columns
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        want = [
            lambda: ids(toxicity.score(docs, labels).where("predicted = 0")),
            lambda: ids(quality.judge(docs, labels).where("kept")),
            lambda: ids(exact_dedup.dedup(docs).where("kept")),
            lambda: {r["component_id"] for r in simhash.near_duplicates(docs).collect()},
            lambda: ids(docs),
        ][i]()
        assert ids(made) == want
        docs = made
    assert docs.count() >= len(want) and {"sequence_id", "offset"} <= set(docs.columns)
    assert sorted(r["length"] for r in docs.collect()) == sorted(r["length"] for r in corpus_pipeline.run(spark, SF).collect())
    assert packing.CAPACITY == 4096


def brute_run(rows):
    """The pieces of run() without labels, in plain Python: base rules, exact and near copies, tokens."""
    rows = [r for r in rows if (s := brute_statistics(r[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r)
    some = lambda ids, pick: pick((i for i in ids if i is not None), default=None)
    rows = [next(r for r in g if r[0] == some([x[0] for x in g], max)) for g in groups.values()]
    named = brute_components([(i, brute_print(t)) for i, (_, t) in enumerate(rows)])
    near = defaultdict(list)
    for (_, t), (_, fp, c) in zip(rows, named, strict=True):
        near[c].append((fp, t))
    by_text = {t: i for i, t in rows}
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for members in near.values():
        least = some([by_text[t] for _, t in members], min)
        (text,) = {t for _, t in members if by_text[t] == least} if least is not None else {members[0][1]}
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        out += [(least, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    return out


def test_run_against_brute_force_on_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(80)) for i in range(30)] + [(None, text(90)), (None, None), (40, None), (41, ""), (42, " \n"), (43, "short text"), (44, "again and " * 90)]
    rows += [(50, rows[0][1].upper()), (51, rows[0][1]), (None, rows[1][1]), (52, rows[2][1]), (52, rows[2][1]), (53, text(30_000)), (54, text(60) + " é 漢字 😀")]
    rows += [(60 + k, rows[3][1] + " " + " ".join(rng.choices(words, k=1))) for k in range(5)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, {"a": 1}, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, m map<string,int>, passages string, score int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in pieces]
    assert Counter(got) == Counter(brute_run(rows))
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_run_against_brute_force_with_labels_of_both_kinds(spark, tmp_path):
    """Both models reject documents; what they have learned is applied here by its definition, word by word and node by node."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randrange(2, 7)))
    rows, labels = [], []
    for i in range(420):
        words = [word() for _ in range(rng.randrange(60, 110))]
        toxic, bad = i % 6 == 0, i % 7 == 3
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(["vilest", "rotten", "foulmouth", "scumbag"], 3)
        if bad:
            words = [w + rng.choice(("###", "<<>>", "$%&|")) if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[i][1].upper()) for i in range(0, 60, 4)] + [(2000 + i, rows[i][1] + " " + word()) for i in range(1, 60, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    docs, known = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    model = toxicity.fit(docs, known)
    clean = [r for r in rows if brute_score(model, r[1]) < 0.7]
    assert {i for i in range(0, 420, 6)} == {i for i, _ in rows if i < 420} - {i for i, _ in clean}
    forest = quality.fit(docs.join(spark.createDataFrame([(i,) for i, _ in clean], "doc_id long"), "doc_id"), known)

    def anomaly(text):
        scaled = np.log1p(quality.statistics([text])[1] / forest.typical)[0]
        at = [tree[4][walk(tree, scaled)] for tree in forest.forest.trees]
        return 2.0 ** (-np.mean(at) / forest.forest._usual(forest.forest.tree_rows))

    good = [r for r in clean if anomaly(r[1]) <= forest.threshold]
    lost = {i for i, _ in clean} - {i for i, _ in good}
    assert sum(i % 7 == 3 for i in lost if i < 420) >= 45 and sum(i % 7 != 3 for i in lost if i < 420) < 10
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(brute_run(good))


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
