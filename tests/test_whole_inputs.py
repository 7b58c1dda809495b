"""Nothing is lost: empty cells, any columns, unknown ids, long chains, Unicode spaces, stream batches run again."""

import pytest
from pyspark.sql import functions as F

from sextant.functions.text import normalize_text, strip_ws, word_count
from sextant.operators import candidates as C
from sextant.operators.components import connected_components
from sextant.operators.density import dbscan_sweep
from sextant.operators.quality import alignment_check
from sextant.operators.tokens import rule_annotate
from sextant.sources.csv import MAX_COLUMNS, read_dataset_dir
from sextant.sources.tables import TURNS, turn_key


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_rows_with_empty_cells_and_more_columns(spark, tmp_path, multi_line):
    write(tmp_path / "one.csv", 'id,text,intent\n0,hello,Greet\n1,,Greet\n2,bye,\n3,"a ""b"", c",None\n')
    write(tmp_path / "two.csv", "split,intent,id,text\ntrain,Greet,0,hi\ntest,,1,\n")
    rows = sorted(tuple(r) for r in read_dataset_dir(spark, str(tmp_path), multi_line=multi_line)
                  .select("dataset", "id", F.coalesce("text", F.lit("-")), F.coalesce("intent", F.lit("-"))).collect())
    assert rows == [("one", 0, "hello", "Greet"), ("one", 1, "-", "Greet"), ("one", 2, "bye", "-"), ("one", 3, 'a "b", c', "None"),
                    ("two", 0, "hi", "Greet"), ("two", 1, "-", "-")]


def test_csv_headers_belong_to_their_own_file(spark, tmp_path):
    write(tmp_path / "a" / "x.csv", "id,text,intent\n0,t,i\n")
    write(tmp_path / "b" / "x.csv", "intent,text,id\ni2,t2,5\n")
    rows = sorted(tuple(r) for r in read_dataset_dir(spark, str(tmp_path / "*")).select("id", "text", "intent").collect())
    assert rows == [(0, "t", "i"), (5, "t2", "i2")]


def test_csv_with_too_many_columns_fails(spark, tmp_path):
    names = ["id", "text", "intent", *(f"c{k}" for k in range(MAX_COLUMNS))]
    write(tmp_path / "wide.csv", ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    with pytest.raises(Exception, match="more than"):
        read_dataset_dir(spark, str(tmp_path)).collect()


def test_alignment_keeps_an_attempt_without_known_ids(spark):
    vectors = spark.createDataFrame([(i,) for i in range(4)], "id long")
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 90), (1, 91), (1, 92)], "param_idx int, id long")
    rows = {r["param_idx"]: (r["labels_without_vector"], r["vectors_without_label"]) for r in alignment_check(vectors, labels).collect()}
    assert rows == {0: (0, 2), 1: (3, 4)}


def test_components_of_an_ordered_path_over_many_tasks(spark):
    n = 20_000
    nodes = spark.range(n + 1)
    edges = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    roots = connected_components(nodes, edges, edges_per_task=6_000)
    assert {(r["root"], r["count"]) for r in roots.groupBy("root").count().collect()} == {(0, n), (n, 1)}


def test_components_by_key_over_many_tasks(spark):
    import random
    rng = random.Random(1)
    edges = [(k, rng.randrange(300), rng.randrange(300)) for k in range(3) for _ in range(180)]
    nodes = spark.range(300).crossJoin(spark.range(3).select(F.col("id").alias("run")))
    got = {(r["run"], r["id"]): r["root"] for r in connected_components(
        nodes, spark.createDataFrame(edges, "run long, i long, j long"), ["run"], edges_per_task=100).collect()}
    for run in range(3):
        up = list(range(300))

        def find(a):
            while up[a] != a:
                a = up[a]
            return a
        for k, i, j in edges:
            if k == run:
                a, b = sorted((find(i), find(j)))
                up[b] = a
        assert all(got[run, i] == find(i) for i in range(300))


def test_dbscan_follows_an_ordered_chain(spark):
    import math
    step, n = 0.02, 200
    rows = [(i, [math.cos(i * step), math.sin(i * step)]) for i in range(n)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    labels = dbscan_sweep(vectors, [1 - math.cos(1.5 * step)], 2)
    assert {r["cluster_id"] for r in labels.collect()} == {0}


def test_unicode_spaces(spark):
    text = "a b　c\x1cd"
    row = spark.createDataFrame([(text, " x  ")], "t string, s string").select(
        word_count("t").alias("n"), strip_ws("s").alias("s"), normalize_text("t").alias("k")).first()
    assert row["n"] == len(text.split()) == 4 and row["s"] == "x"


def test_first_pair_stays_in_the_row(spark):
    docs = spark.createDataFrame([(1, "walking the station lasted long."), (2, None), (3, "")], "id long, text string")
    out = C.action_object_ext(rule_annotate(docs, "text", "tokens"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    pairs = C.explode_pairs(rule_annotate(docs, "text", "tokens")).where("pair_no = 0")
    want = {r["id"]: r["pair"] for r in pairs.collect()}
    assert {r["id"]: r["candidate_intent"] for r in out.collect()} == {i: want.get(i, "NONE") for i in (1, 2, 3)}


def test_turn_key_does_not_merge_turns(spark):
    fine = spark.createDataFrame([(2, 5)], "conv_id long, turn long")
    assert fine.select(turn_key("conv_id", "turn").alias("k")).first()["k"] == 2 * TURNS + 5
    with pytest.raises(Exception, match="not below"):
        spark.createDataFrame([(2, TURNS)], "conv_id long, turn long").select(turn_key("conv_id", "turn")).collect()
