import copy
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import prose
from factloom.plans import catalog, ledger, passes, proof, story, verify
from factloom.sources import delimited, quoted

SF = "/root/testdata/sf0.001"
MONTHS = [f"2024-{m:02d}" for m in range(1, 13)] + ["2025-01", "2025-02"]
REVENUE = [100, 104, 103, 108, 109, 111, 113, 118, 200, 204, 209, 211, 220, 226]
USERS = [50, 51, 53, 52, 55, 57, 58, 60, 98, 101, 104, 106, 109, 113]
SOURCE = "\n".join(["month,revenue,users", *(f"{m},{a},{b}" for m, a, b in zip(MONTHS, REVENUE, USERS, strict=True))])


def test_delimited_text(spark):
    t = delimited.from_text(spark, '﻿month;name;note;on\r\n2024-01;"a;b";x"y;z"w;yes\r\n\r\n2024-02;"say ""hi""";n/a;no\r\n')
    assert t.kinds == {"month": "date", "name": "string", "note": "string", "on": "boolean"}
    rows = t.df.orderBy("row_id").collect()
    assert [(r["name"], r["note"], r["on"]) for r in rows] == [("a;b", "xy;zw", True), ('say "hi"', None, False)]


def test_delimiters_names_and_caps(spark):
    assert [delimited.sniff(x) for x in (["a;b", "1;2"], ["a\tb"], ["a|b"], ["abc"])] == [";", "\t", "|", ","]
    assert delimited.unique_names(["a", "A", "", " b "]) == ["a", "A_2", "column_3", "b"]
    t = delimited.from_text(spark, "a,b\n" + "\n".join(f"{i},{i}" for i in range(50)), max_rows=20, max_columns=1)
    assert t.df.count() == 20 and list(t.kinds) == ["a"] and len(t.notes) == 2
    for bad in ("", "   ", "a,b"):
        with pytest.raises(delimited.InputError):
            delimited.from_text(spark, bad)
    with pytest.raises(delimited.InputError):
        delimited.from_text(spark, "a\n1", max_bytes=2)


def test_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text('month,revenue\n2024-01,"1,000"\n2024-02,2000\n')
    t = delimited.from_path(spark, str(tmp_path / "x.csv"))
    assert t.kinds == {"month": "date", "revenue": "number"} and t.df.agg(F.sum("revenue")).first()[0] == 3000


def test_files_are_split(spark, tmp_path):
    lines = ["k,v", *(f"{i},{i * 2}" for i in range(20_000))]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        t = delimited.from_path(spark, str(tmp_path / "x.csv"))
        assert [(r["row_id"], r["k"]) for r in t.df.orderBy("row_id").collect()] == [(i, float(i)) for i in range(20_000)]
        assert t.df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    capped = delimited.from_path(spark, str(tmp_path / "x.csv"), max_rows=50, max_columns=1)
    assert capped.df.count() == 50 and list(capped.kinds) == ["k"] and len(capped.notes) == 2
    (tmp_path / "empty.csv").write_text("a,b\n\n \n")
    with pytest.raises(delimited.InputError):
        delimited.from_path(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "y.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [r["b"] for r in delimited.from_path(spark, str(tmp_path / "y.csv")).df.orderBy("row_id").collect()] == ["x\ny", "z"]


def test_fields_are_those_of_records():
    rng = random.Random(11)
    for _ in range(2000):
        text = "".join(rng.choice('ab",,"" \n') for _ in range(rng.randint(1, 25)))
        if all(text[:i].count('"') % 2 for i, c in enumerate(text) if c == "\n"):  # one record
            assert [quoted.fields(text, ",")] == (delimited.records(text, ",") or [[""]]), text


@pytest.mark.parametrize("size", [1, 7, 40])
def test_files_are_read_by_the_rules_of_texts_at_every_cut(spark, tmp_path, size):
    rng = random.Random(size)
    text = "k,v\n" + "".join(rng.choice(['a', 'é', ',', '\n', '""', '"', '5" pipe', '\r\n', ' ', 'x,"y\nz",w\n']) for _ in range(70))
    text = text if text.count('"') % 2 == 0 else text + '"'
    (tmp_path / "x.csv").write_bytes(("\ufeff" + text + "\nend,1").encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(size))
        top, rows = quoted.records(spark, str(tmp_path / "x.csv"), ",")
        got = [(r["row_id"], r["cells"]) for r in rows.orderBy("row_id").collect()]
    finally:
        for n in names:
            spark.conf.set(n, before[n])
    want = [r for r in delimited.records((text + "\nend,1").replace("\r\n", "\n").replace("\r", "\n"), ",") if any(c.strip() for c in r)]
    assert top == want[0] == ["k", "v"] and got == list(enumerate(want[1:]))


def test_folders_and_quotes_that_are_not_closed(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.csv").write_text('a,b\n3,"x\n')
    (tmp_path / "d" / "a.csv").write_text('a,b\n1,"p\nq"\n2,r\n')
    t = delimited.from_path(spark, str(tmp_path / "d"))
    assert [(r["row_id"], r["a"], r["b"]) for r in t.df.orderBy("row_id").collect()] == [(0, 1.0, "p\nq"), (1, 2.0, "r"), (2, 3.0, "x")]
    t = delimited.from_path(spark, str(tmp_path / "d" / "a.csv"), names=["a", "b"])
    assert t.df.count() == 3
    monkeypatch.setattr(quoted, "LONGEST", 2)
    with pytest.raises(delimited.InputError):
        delimited.from_path(spark, str(tmp_path / "d"))


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from factloom import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Frame:
        class sparkSession:
            sparkContext = Context

    with pytest.raises(ValueError):
        session.checkpoint(Frame)


@pytest.fixture(scope="module")
def facts(spark):
    return ledger.facts_of(delimited.from_text(spark, SOURCE, "demo"))


def test_ledger(facts):
    kinds = {f.kind for f in facts}
    assert {"overview", "trend", "changepoint", "correlation", "extreme"} <= kinds
    assert len({f.id for f in facts}) == len(facts)
    assert [f.importance for f in facts] == sorted((f.importance for f in facts), reverse=True)
    change = next(f for f in facts if f.kind == "changepoint" and f.columns == ["revenue"])
    assert change.values["before"] == pytest.approx(sum(REVENUE[:8]) / 8, abs=0.01)
    trend = next(f for f in facts if f.kind == "trend" and f.columns == ["revenue"])
    assert trend.values["changePct"] == 126 and trend.source_rows == list(range(14)) and trend.confidence["level"] == "high"


def test_charts(facts):
    by = {f.kind: json.loads(f.chart) for f in facts if f.chart}
    assert by["trend"]["type"] == "line" and len(by["trend"]["points"]) == 14 and "slope" in by["trend"]["trend"]
    assert by["changepoint"]["mark"] == 8 and by["changepoint"]["points"][8]["value"] in (200, 98)
    assert by["correlation"]["type"] == "scatter" and len(by["correlation"]["points"]) == 14


def test_store(spark, signed, tmp_path):
    from factloom.sources import stories

    _, made = signed
    path = str(tmp_path / "stories")
    stories.save(spark, path, [made])
    stories.save(spark, path, [made | {"id": "0123456789"}])
    assert stories.count(spark, path) == 2 and stories.find(spark, path, made["id"])["title"] == made["title"]
    assert stories.find(spark, path, "x' OR 1=1") is None and stories.find(spark, path, "zzzzzzzzzz") is None


def test_audit_of_texts_moves_no_texts_to_the_driver(spark):
    """Spark takes allowed numbers that come from the driver for endless, and so would broadcast the texts' numbers."""
    texts = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("text_id"), F.concat(F.lit("at "), "event_id").alias("text"))
    got = story.audit_texts(texts, spark.createDataFrame([(None, 41.5), (7, 7.0)], "text_id long, number double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert {r["text_id"] for r in got.where("verified > 0").collect()} == {7, 41, 42}


def test_audit_of_texts_against_each_pair(spark):
    rng = random.Random(5)
    rows = [(i // 2, " and ".join(f"{rng.uniform(-1, 1) * 10 ** rng.randint(-2, 7):.{rng.randint(0, 3)}f}" for _ in range(rng.randint(0, 6)))) for i in range(200)]
    rows += [(200, None), (201, "none"), (202, "9" * 400)]
    allowed = [(rng.choice([None, *range(100)]), rng.uniform(-1, 1) * 10 ** rng.randint(-2, 7)) for _ in range(400)] + [(None, float("inf")), (None, float("nan"))]
    of: dict[int, set[float]] = {}
    for i, text in rows:
        of.setdefault(i, set()).update(story.numbers_in(text or ""))
    own = lambda i: [abs(x) for k, x in allowed if k in (None, i)]
    near = lambda n, a: abs(n - a) <= prose.NEAR or abs(n - a) / a <= prose.NEAR_SHARE
    want = {(i, len(ns), sum(any(near(n, a) for a in own(i)) for n in ns)) for i, ns in of.items()}
    got = story.audit_texts(spark.createDataFrame(rows, "text_id long, text string"), spark.createDataFrame(allowed, "text_id long, number double"))
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want


def test_narrator_is_audited(facts):
    chosen = story.select_scenes(facts)
    honest = chosen[0].statement
    _, scenes = story.narrate(facts, "demo", lambda fs: {fs[0].id: honest, fs[1].id: "It hit 987654."}, ["revenue", "users"])
    bodies = [s["body"] for s in scenes if s["kind"] == "insight"]
    assert bodies[0] == honest and "987654" not in bodies[1]

    def broken(fs):
        raise RuntimeError

    assert story.narrate(facts, "demo", broken)[1] == story.narrate(facts, "demo")[1]
    _, counts = story.told(chosen, lambda fs: {fs[0].id: "It hit 987654."}, [])
    assert counts["checked"] == 1 and counts["verified"] == 0 and counts["rewritten"] == len(chosen)


def test_question_lifts_its_facts(spark, facts):
    asked = ledger.facts_of(delimited.from_text(spark, SOURCE, "demo"), "what about users?")
    of = lambda fs: max(f.importance for f in fs if f.columns[:1] == ["users"])
    assert of(asked) > of(facts) or of(asked) == 100


def test_scenes(facts):
    scenes = story.select_scenes(facts)
    assert 3 <= len(scenes) <= 7
    assert max(sum(f.kind == g.kind for g in scenes) for f in scenes) <= 2


def test_ledger_does_not_depend_on_partitions(spark, facts):
    t = delimited.from_text(spark, SOURCE, "demo")
    t.df = t.df.repartition(11, F.rand(3))
    assert ledger.facts_of(t) == facts


@pytest.fixture(scope="module")
def signed(spark):
    signer = proof.new_signer(spark)
    return signer, story.create(delimited.from_text(spark, SOURCE, "demo"), SOURCE, signer=signer)


def forged(made, how):
    x = copy.deepcopy(made)
    how(x)
    return x


def insight(x):
    return next(s for s in x["scenes"] if s["kind"] == "insight")


def test_untouched_story_is_verified(spark, signed):
    signer, made = signed
    report = verify.verify(spark, SOURCE, made, {signer.public_key}, strict=True)
    assert report.verdict == "VERIFIED" and report.facts_checked == len(made["facts"])


def test_signed_forgeries(spark, signed):
    signer, made = signed
    trusted = {signer.public_key}
    verdict = lambda x, source=SOURCE: verify.verify(spark, source, x, trusted).verdict
    assert verdict(made, SOURCE.replace("104", "105")) == "SOURCE_MISMATCH"
    assert verdict(forged(made, lambda x: x["facts"][0]["values"].update(first=1.0))) == "TAMPERED"
    other = proof.new_signer(spark)
    assert verdict(forged(made, lambda x: x.update(proof=proof.sign(SOURCE, x, other, "factloom")))) == "TAMPERED"
    assert verdict(forged(made, lambda x: x["proof"].update(signature="AAAA"))) == "TAMPERED"


def test_unsigned_forgeries(spark, signed):
    _, made = signed
    bare = {k: v for k, v in made.items() if k != "proof"}
    verdict = lambda how: verify.verify(spark, SOURCE, forged(bare, how), set()).verdict
    assert verdict(lambda x: None) == "LEGACY_UNVERIFIED"
    assert verdict(lambda x: insight(x)["claim"].update(direction="down")) == "UNSUPPORTED_CLAIM"
    assert verdict(lambda x: insight(x).update(body=insight(x)["body"].replace("revenue", "users"), headline="x")) == "UNSUPPORTED_CLAIM"
    assert verdict(lambda x: insight(x).update(body="It reached 987654.")) == "UNSUPPORTED_CLAIM"
    assert verdict(lambda x: insight(x).update(factIds=["F99"])) == "UNSUPPORTED_CLAIM"
    assert verdict(lambda x: [s.pop("claim", None) for s in x["scenes"]]) == "LEGACY_UNVERIFIED"
    assert verdict(lambda x: x["facts"][1].update(statement="else")) == "TAMPERED"


def test_left_out_facts_need_strict(spark, signed):
    _, made = signed
    bare = forged({k: v for k, v in made.items() if k != "proof"}, lambda x: (x["facts"].pop(), x["scenes"][-1].update(body="")))
    assert verify.verify(spark, SOURCE, bare, set()).verdict == "LEGACY_UNVERIFIED"
    assert verify.verify(spark, SOURCE, bare, set(), strict=True).verdict == "TAMPERED"


@pytest.fixture(scope="module")
def directed(spark):
    """Unsigned stories of a rising and of a falling measure, and what verification computes of their sources."""
    out = {}
    for way, values in (("up", [10, 12, 15, 19, 24, 31, 40]), ("down", [40, 31, 24, 19, 15, 12, 10])):
        text = "month,revenue\n" + "\n".join(f"2024-0{i + 1},{v}" for i, v in enumerate(values))
        made = story.create(delimited.from_text(spark, text, "demo"), text)
        out[way] = made, {f["id"]: verify.fact_of(f) for f in made["facts"]}
    return out


@pytest.mark.parametrize(("way", "words"), [("up", prose.DOWN_WORDS), ("down", prose.UP_WORDS)])
def test_each_word_against_a_fact_is_found(directed, way, words):
    made, said = directed[way]
    metrics = story.metrics_of(list(said.values()))
    assert not verify._scene_failures(made, said, said, metrics)[0]
    for word in words.split():
        bad = forged(made, lambda x: next(s for s in x["scenes"] if s.get("claim", {}).get("operation") == "ols_trend").update(headline="x", body=f"revenue {word}."))  # noqa: B023
        assert verify._scene_failures(bad, said, said, metrics)[0], word


def test_a_forged_word_gives_the_verdict(spark, signed):
    _, made = signed
    bare = forged({k: v for k, v in made.items() if k != "proof"}, lambda x: insight(x).update(headline="x", body="It plunged."))
    assert verify.verify(spark, SOURCE, bare, set()).verdict == "UNSUPPORTED_CLAIM"


def test_scenes_of_many_ledgers(spark):
    rng, rows, want = random.Random(5), [], {}
    for k in range(40):
        own = [
            ledger.Fact(rng.choice([*story.ARC, "other"]), "", "", rng.randrange(0, 60), [rng.choice("abc")] if rng.random() < 0.9 else [], {}, seq=i + 1)
            for i in range(rng.randrange(0, 25))
        ]
        own.sort(key=lambda f: (-f.importance, f.seq))
        rows += [(k, f.seq, f.kind, f.columns, f.importance) for f in own]
        want[k] = [(f.seq, f.kind) for f in story.select_scenes(own)]
    df = spark.createDataFrame(rows, "k long, seq int, kind string, columns array<string>, importance int").repartition(7)
    got = {}
    for r in story.scenes_of_ledgers(df, ["k"]).orderBy("k", "scene").collect():
        got.setdefault(r["k"], []).append((r["seq"], r["kind"]))
    assert got == {k: v for k, v in want.items() if v}


def test_medians_of_long_series_are_the_same(spark, facts, monkeypatch):
    monkeypatch.setattr(passes, "SORTED", 0)
    assert ledger.facts_of(delimited.from_text(spark, SOURCE, "demo")) == facts


def test_an_emitter_adds_no_scan(spark):
    table = delimited.from_text(spark, SOURCE, "demo")
    spikes = ledger.Emitter(
        {"over": F.count_if(F.col("v") > 200), "third": F.max(F.when(F.col("i") == 2, F.col("v")))},
        lambda m, x: [ledger.Fact("spikes", f"{m} spikes", f"{m} is over 200 at {x['over']} points.", 33, [m], {"over": float(x["over"]), "third": x["third"]})],
    )
    before = ledger.facts_of(table)
    found = ledger.facts_of(table, emitters=[spikes])
    own = [f for f in found if f.kind == "spikes"]
    assert {f.columns[0] for f in own} == {f.columns[0] for f in before if f.kind == "extreme"}
    assert {(f.kind, f.statement) for f in found} - {(f.kind, f.statement) for f in own} == {(f.kind, f.statement) for f in before}
    with pytest.raises(ValueError):
        ledger.facts_of(table, emitters=[ledger.Emitter({"n": F.count("v")}, lambda m, x: [])])


def test_no_number_column_may_be_swapped_in(spark):
    names = [f"m{x}" for x in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "row")]
    text = "\n".join([",".join(["month", *names]), *(",".join([f"2023-{i + 1:02d}", *(str((i + 2) * (k + 3) % (11 + k) + k * i) for k in range(11))]) for i in range(12))])
    signer = proof.new_signer(spark)
    made = story.create(delimited.from_text(spark, text, "demo"), text, signer=signer)
    fresh = verify.recompute(spark, text, "demo")
    assert fresh.metrics == names and set(story.metrics_of(fresh.facts)) < set(names)
    verdict = lambda x: verify.verify(spark, text, x, {signer.public_key}, fresh=fresh).verdict
    assert verdict(made) == "VERIFIED"
    bare = {k: v for k, v in made.items() if k != "proof"}
    own = {c for f in made["facts"] if f["id"] in insight(made)["factIds"] for c in f["columns"]}
    for name in names:
        x = forged(bare, lambda x: insight(x).update(headline="So it went", body=f"It is all about {name}."))  # noqa: B023
        x["proof"] = proof.sign(text, x, signer, "factloom")
        assert verdict(x) == ("VERIFIED" if name in own else "UNSUPPORTED_CLAIM"), name


def test_digests_and_source_rows_do_not_depend_on_partitions(spark):
    df = spark.range(100).select((F.col("id") % 13).alias("a"), F.concat(F.lit("k"), F.col("id") % 5).alias("b"), (F.col("id") * 7 % 50 / 3).alias("c"))
    tables = [delimited.from_frame(df.repartition(n, F.rand(n)), name="t") for n in (1, 2, 50)]
    assert len({proof.table_digest(t) for t in tables}) == 1
    assert ledger.facts_of(tables[0]) == ledger.facts_of(tables[2])
    assert proof.table_digest(tables[0]) != proof.table_digest(delimited.from_frame(df.union(df.limit(1)), name="t"))


def test_malformed_stories_are_judged(spark, signed):
    signer, made = signed
    fresh = verify.recompute(spark, SOURCE, "demo")
    bad = [
        None, [], {}, "x", 7, {"facts": []}, made | {"facts": None}, made | {"scenes": {}}, made | {"dataset": []}, made | {"title": 3}, made | {"question": 7},
        made | {"proof": "x"}, made | {"proof": {}}, made | {"proof": made["proof"] | {"publicKey": ["x"]}}, made | {"proof": made["proof"] | {"signature": None}},
    ]
    change = lambda part, **more: forged(made, lambda x: x[part][1].update(more))
    bad += [change("facts", **{k: v}) for k, v in (("values", None), ("values", {"a": "text"}), ("values", {"a": float("nan")}), ("columns", "revenue"), ("columns", [1]), ("id", 7), ("kind", None), ("statement", {}))]
    bad += [change("scenes", **{k: v}) for k, v in (("headline", None), ("body", 5), ("kind", []), ("claim", "text"), ("factIds", 3), ("factIds", [{}]), ("stat", {"value": "x"}))]
    bad += [forged(made, lambda x, k=k: x["facts"][1].pop(k)) for k in ("values", "kind", "id", "columns")] + [forged(made, lambda x, k=k: x.pop(k)) for k in ("facts", "scenes", "dataset", "title")]
    for x in bad:
        report = verify.verify(spark, SOURCE, x, {signer.public_key}, fresh=fresh)
        assert report.verdict in ("TAMPERED", "SOURCE_MISMATCH", "LEGACY_UNVERIFIED") and any(report.checks.values()), x
        if isinstance(x, dict) and isinstance(x.get("proof"), dict) and x["proof"]:
            assert report.verdict == "TAMPERED"
    odd = forged({k: v for k, v in made.items() if k != "proof"}, lambda x: insight(x).update(claim={"factId": ["F1"]}))
    assert verify.verify(spark, SOURCE, odd, set(), fresh=fresh).verdict == "UNSUPPORTED_CLAIM"


def test_stories_of_typed_tables(spark):
    rows = [(i, f"2024-{i + 1:02d}-01", float(r), float(u)) for i, (r, u) in enumerate(zip(REVENUE[:12], USERS[:12], strict=True))]
    df = spark.createDataFrame(rows, "k long, month string, revenue double, users double").withColumn("month", F.to_date("month"))
    table = lambda d: delimited.from_frame(d, "k", "demo")
    signer = proof.new_signer(spark)
    made = story.create(table(df), signer=signer)
    again = table(df.repartition(7, F.rand(1)))
    assert verify.verify(spark, again, made, {signer.public_key}, strict=True).verdict == "VERIFIED"
    other = table(df.withColumn("users", F.when(F.col("k") == 5, 0.0).otherwise(F.col("users"))))
    assert verify.verify(spark, other, made, {signer.public_key}).verdict == "SOURCE_MISMATCH"


def test_digests_of_large_tables(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    one = proof.table_digest(delimited.from_frame(df, "id"))
    monkeypatch.setattr(proof, "BRANCHES", 16)
    deep = proof.table_digest(delimited.from_frame(df, "id"))
    assert deep == proof.table_digest(delimited.from_frame(df.orderBy("v").repartition(9), "id")) != one
    changed = df.withColumn("v", F.when(F.col("id") == 17, 9).otherwise(F.col("v")))
    assert proof.table_digest(delimited.from_frame(changed, "id")) != deep
    assert proof.table_digest(delimited.from_frame(df.unionByName(df.limit(1)), "id")) != deep


def test_signers_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(proof.KEY_VARIABLE, raising=False)
    monkeypatch.delenv(proof.PUBLIC_VARIABLE, raising=False)
    made = proof.load_signer(spark, tmp_path / "keys")
    assert ((tmp_path / "keys" / proof.KEY_FILE).stat().st_mode & 0o777) == 0o600
    again = proof.load_signer(spark, tmp_path / "keys")
    assert (again.private_key, again.public_key) == (made.private_key, made.public_key)
    assert proof.signature_holds(spark, again.public_key, b"x", made.sign(b"x"))
    other = proof.new_signer(spark)
    monkeypatch.setenv(proof.KEY_VARIABLE, other.private_key)
    with pytest.raises(ValueError):
        proof.load_signer(spark, tmp_path / "none")
    monkeypatch.setenv(proof.PUBLIC_VARIABLE, other.public_key)
    assert proof.load_signer(spark, tmp_path / "none").public_key == other.public_key and not (tmp_path / "none").exists()
    monkeypatch.setenv(proof.TRUSTED_VARIABLE, f" {made.public_key}, ,")
    assert proof.trusted_keys(other.public_key) == {other.public_key, made.public_key}
    for private, public in ((other.private_key, made.public_key), ("AAAA", made.public_key), (other.private_key, "AAAA")):
        with pytest.raises(ValueError):
            proof.signer_of(spark, private, public)


def test_drafts(facts):
    chosen = story.select_scenes(facts)
    body = [f"{f.statement}" for f in chosen]
    good = {"title": "t", "subtitle": "s", "scenes": [{"headline": "h", "body": b} for b in body]}
    raw = f"Here it is:\n```json\n{json.dumps(good)}\n```"
    assert story.draft_of(raw, len(chosen))["scenes"][0]["body"] == body[0]
    for bad in ("", "{", "no", "[1]", json.dumps(good | {"title": 1}), json.dumps(good | {"scenes": good["scenes"][1:]}), json.dumps(good | {"scenes": [1] * len(chosen)})):
        assert story.draft_of(bad, len(chosen)) is None
    texts, counts = story.told(chosen, lambda fs: raw, [])
    assert texts == dict(zip([f.id for f in chosen], body, strict=True)) and counts["rewritten"] == 0 and counts["checked"] == counts["verified"] > 0
    assert story.told(chosen, lambda fs: "nothing", [])[1]["rewritten"] == len(chosen)


def test_titles_and_tones(facts):
    fact = lambda kind, columns, **values: ledger.Fact(kind, "h", "s", 50, columns, values)
    assert story.title_of([fact("trend", ["mrr"], changePct=5.0), fact("outlier", ["x"])], "demo") == "mrr on the way up"
    assert story.title_of([fact("trend", ["mrr"], changePct=-5.0)], "demo") == "mrr on the way down"
    assert story.title_of([fact("category_leader", ["region", "sales"])], "demo") == "Who carries sales"
    assert story.title_of([fact("correlation", ["a", "b"])], "demo") == "a and b, side by side"
    assert story.title_of([], "demo") == story.title_of([fact("streak", ["a"])], "demo") == "What demo shows"
    bodies = [[s["body"] for s in story.narrate(facts, "demo", tone=t)[1]] for t in story.TONES]
    assert len({b[1] for b in bodies}) == 3
    assert all(k in story._KICKERS for k in story.ARC if k != "overview")


def test_metrics_of_a_ledger():
    fact = lambda kind, *columns: ledger.Fact(kind, "h", "s", 50, list(columns), {})
    some = [fact("overview", "x"), fact("correlation", "a", "b"), fact("category_leader", "k", "c"), fact("trend", "a"), fact("outlier", "d")]
    assert story.metrics_of(some) == ["a", "b", "c", "d"]


def test_too_little(spark):
    with pytest.raises(delimited.InputError):
        story.create(delimited.from_text(spark, "a,b\nx,y\nz,w", "t"), "a,b\nx,y\nz,w")


def norm(v):
    return [norm(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(repr([norm(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
    assert got == want


def test_streams(spark, tmp_path):
    from factloom.streaming import events as streams

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / "e"))
    live = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "e")).schema).parquet(str(tmp_path / "in" / "*"))
    assert schema
    for name, df in (
        ("hits", streams.daily_hits(live(), late="1 hour")),
        ("seen", streams.first_seen_stream(live(), ["user_id"])),
        ("tumbling", streams.tumbling(live(), late="1 hour")),
        ("sums", streams.daily_sums(live(), "1 hour")),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() > 0


def test_sums_of_batches_add_up(spark, tmp_path):
    from factloom.streaming import events as streams

    # large against their spread, where raw squares would cancel
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("value", F.col("value") + 1e8)
    path = str(tmp_path / "sums")
    for epoch in (0, 1, 1):  # a batch that comes twice counts once
        part = events.where(F.col("event_id") % 2 == epoch)
        streams.write_sums(part.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(*streams.day_cells()), epoch, path)
    got = {(r["event_type"], r["day"]): r for r in streams.totals(spark, path).collect()}
    want = events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev")
    )
    rows = want.collect()
    assert len(rows) == len(got)
    for r in rows:
        g = got[r["event_type"], r["day"]]
        assert (g["n"], g["mean"], g["stdev"]) == (r["n"], pytest.approx(r["mean"]), pytest.approx(r["stdev"], abs=1e-6))


def test_forgery_verdicts_take_all_months(spark, monkeypatch):
    from factloom.plans import queries_ledger
    from factloom.sources import delimited

    sf, texts, made = "/root/testdata/sf0.001", [], delimited.from_text
    monkeypatch.setattr(delimited, "from_text", lambda s, text, *a, **k: texts.append(text) or made(s, text, *a, **k))
    got = {r["name"]: r["verdict"] for r in queries_ledger.forgery_verdicts(spark, sf).collect()}
    months = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("trunc(CAST(o_orderdate AS DATE), 'month') AS m").distinct().count()
    assert months > 40 and len(texts[0].splitlines()) == months + 1
    assert len(set(got.values())) == 5
