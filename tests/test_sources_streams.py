import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evigraph.plans import catalog
from evigraph.sources import scan
from evigraph.streaming import state as st


def test_corpus_and_jsonl(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "a.md").write_text("# A\nx")
    (tmp_path / "c" / "sub" / "b.md").write_text("B")
    (tmp_path / "c" / "n.txt").write_text("no")
    got = {r.path: r.text for r in scan.scan_corpus(spark, str(tmp_path / "c")).collect()}
    assert got == {"a.md": "# A\nx", "sub/b.md": "B"}
    p = tmp_path / "r.jsonl"
    p.write_text('{"record_type":"chunk_result","chunk_id":"1"}\n{bad\n{"record_type":"chunk_error","chunk_id":"2"}\n')
    rows, counts = scan.scan_tagged_jsonl(spark, str(p), tag="chunk_result")
    assert [r.chunk_id for r in rows.collect()] == ["1"]
    assert {r.record_type: r.n for r in counts.collect()} == {"chunk_result": 1, "chunk_error": 1, "bad_row": 1}
    with pytest.raises(Exception):
        scan.scan_tagged_jsonl(spark, str(p), tag="chunk_result", strict=True)[0].collect()


def test_alias_and_reclass_files(spark, tmp_path):
    d = tmp_path / "aliases"
    d.mkdir()
    (d / "pathogen_aliases.json").write_text(json.dumps({"merge_groups": [{"canonical_name": "CMV", "aliases": ["a", "b"]}], "DELETE": ["junk"]}))
    (d / "other.json").write_text("{}")
    alias, delete = scan.scan_alias_rules(spark, str(d))
    assert sorted((r.label, r.canonical, r.alias) for r in alias.collect()) == [("Pathogen", "CMV", "CMV"), ("Pathogen", "CMV", "a"), ("Pathogen", "CMV", "b")]
    assert [(r.label, r.name) for r in delete.collect()] == [("Pathogen", "junk")]
    f = tmp_path / "reclass.json"
    f.write_text(json.dumps({"RiskFactor": {"Disease": ["x"], "DELETE": ["y", " "]}}))
    assert sorted(tuple(r) for r in scan.scan_reclass_rules(spark, str(f)).collect()) == [("RiskFactor", "x", "Disease"), ("RiskFactor", "y", "DELETE")]


def test_cases_from_array_and_lines(spark, tmp_path):
    case = {"case_id": "c", "slot_truth_map": {"n": {"node_id": "n", "value": "true", "group": "lab"}}}
    (tmp_path / "c.json").write_text(json.dumps([case]))
    (tmp_path / "c.jsonl").write_text(json.dumps(case))
    for name in ("c.json", "c.jsonl"):
        assert [tuple(r)[:4] for r in scan.scan_cases(spark, str(tmp_path / name))[1].collect()] == [("c", "n", "true", "lab")]


def test_requirements_first_wins(spark):
    rows = spark.createDataFrame([("1", "Flu", [["a"]], 1), ("1", "flu ", [["b"]], 2), ("2", "x", [], 0)], "disease_id string, disease_name string, required array<array<string>>, ord int")
    by_id, by_name = scan.requirement_index(rows)
    assert [(r.disease_id, r.required) for r in by_id.collect()] == [("1", [["a"]])]
    assert [(r.name_key, r.required) for r in by_name.collect()] == [("flu", [["a"]])]


def session_rows(n=240):
    """Events of a few sessions with ties in time, blanks and repeated deliveries."""
    rnd = random.Random(4)
    at = datetime(2024, 1, 1)
    rows = [(i % 4, at + timedelta(minutes=i // 3), i, rnd.choice(["a", "b", " ", None]), rnd.choice(["", f"D{i}"]), rnd.choice([None, f"N{i % 5}"]),
             rnd.choice(["present", "absent", "unclear"]), rnd.choice(["", f"t{i % 6}"]), rnd.choice([None, "s1", "s2"]), rnd.choice("xy"), rnd.random() < 0.5) for i in range(n)]
    return rows, "session_id long, ts timestamp, event_id long, name string, display string, node_id string, polarity string, evidence string, slot string, key string, failed boolean"


def batch_state(rows):
    """The same folds, session by session, in order."""
    out, rank = {}, {"present": 3, "unclear": 2}
    for s in {r[0] for r in rows}:
        mine, until, fails = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])), {}, 0
        for turn, (_, ts, i, name, _, _, _, _, _, key, failed) in enumerate(mine, 1):
            fails = fails + 1 if failed else 0
            out["turn", s, st.place_text(ts, i)] = (turn, turn < until.get(key, -1), fails)
            if failed:
                until[key] = max(until.get(key, -1), turn + 2)
        for name in {r[3] for r in mine if r[3] and r[3].strip()}:
            m = [r for r in mine if r[3] == name]
            first = lambda k: next((r[k] for r in m if r[k]), None)  # noqa: B023, E731
            out["mention", s, name] = (max((r[6] for r in m), key=lambda p: rank.get(p, 1)), first(5), first(4), len({r[7] for r in m if r[7]}), len(m))
        for slot in {r[8] for r in mine if r[8]}:
            m = [r for r in mine if r[8] == slot]
            out["slot", s, slot] = (m[-1][6], len({r[7] for r in m if r[7]}), len(m))
    return out


def streamed(spark, rows, schema, batches, folder, **settings):
    """Newest version of every state row after the given batches (lists of rows)."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live = spark.readStream.schema(schema).parquet(f"{folder}/in")
        with st.state_settings(spark):
            st.run_available(st.stream_session_state(live, **settings), f"{folder}/out", f"{folder}/mark", "update")
    pick = {"turn": ("turn", "suppressed", "fail_count"), "mention": ("polarity", "node_id", "display", "n_evidence", "n_turns"), "slot": ("polarity", "n_evidence", "n_turns")}
    last = st.latest(spark, f"{folder}/out", ["kind", "session_id", "item"]).collect()
    return {(r.kind, r.session_id, r["item"]): tuple(r[c] for c in pick[r.kind]) for r in last}, {r["item"] for r in last if r.late}


def test_session_state_does_not_depend_on_order_or_batches(spark, tmp_path):
    rows, schema = session_rows()
    mixed = random.Random(1).sample(rows, len(rows))
    got, late = streamed(spark, rows, schema, [mixed[:90], mixed[60:200], mixed[200:]], str(tmp_path))  # 30 rows come twice
    assert got == batch_state(rows) and not late


def test_session_state_releases_old_turns(spark, tmp_path):
    """Turns in order leave the buffer and are answered the same; one behind its place is marked."""
    rows, schema = session_rows()
    behind = rows.pop(9)
    got, late = streamed(spark, rows, schema, [rows[:120], rows[120:], [behind]], str(tmp_path), lateness=timedelta(minutes=5))
    want = batch_state(rows)
    assert {k: v for k, v in got.items() if k[0] == "turn" and k[2] not in late} == {k: v for k, v in want.items() if k[0] == "turn"}
    assert late == {st.place_text(behind[1], behind[2])}


def test_first_results_do_not_depend_on_batches(spark, tmp_path):
    rows = [(i % 7, (i * 37) % 50, i, float(i)) for i in range(100)]
    schema = "case_id long, ts long, event_id long, value double"
    want = sorted(min(((r[1], r[2], r[3]), r[0]) for r in rows if r[0] == c) for c in range(7))
    for parts in (1, 5):
        folder = str(tmp_path / str(parts))
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{folder}/in")
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        got = st.first_results(live, f"{folder}/out", f"{folder}/mark", ["case_id"], ["ts", "event_id"]).collect()
        assert sorted(((r.ts, r.event_id, r.value), r.case_id) for r in got) == want


def test_fold_does_not_depend_on_partitions(spark):
    rows = [(1, t, "n", p, None, "x", f"e{t % 2}") for t, p in enumerate(("absent", "present", "unclear"))]
    df = spark.createDataFrame(rows, "session_id int, turn int, name string, polarity string, node_id string, display string, evidence string")
    a = st.fold_mentions(df.repartition(3), ["turn"]).collect()
    assert a == st.fold_mentions(df.coalesce(1), ["turn"]).collect()
    assert (a[0].polarity, a[0].n_evidence, a[0].n_turns) == ("present", 2, 3)


def test_every_check_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["session_id", "candidate_id", "pool_rank", "relation_count", "matched_feature_count", "score"]
    assert df.agg(F.count(F.lit(1)).alias("n")).first().n > 0
