"""Stages with paths, sinks, settings and the command line."""

import uuid

import pytest
from pyspark.sql import functions as F

from matchloom import session
from matchloom.operators.counts import observed, stage_counts
from matchloom.plans import cli, extracts, linkage
from matchloom.sinks.tables import jdbc_options, replace_csv, replace_parquet, replace_table
from matchloom.sources.lines import read_numbered_lines
from matchloom.sources.stores import s3a_conf
from matchloom.sources.tabular import read_extract, read_folder, union_by_name
from workload.inputs import address_lines, table, write_lines

CFG = linkage.LinkageConfig(
    id_keys=("identificacao_domicilio_coletivo",), min_score=0.9
)


@pytest.fixture(scope="module")
def landing(spark, sf_dir):
    return write_lines(address_lines(table(spark, sf_dir, "part")), "landing")


def test_stages_one_by_one_equal_the_whole_job(spark, landing, tmp_path):
    counts = linkage.run_linkage(spark, landing, f"{tmp_path}/whole", CFG)
    args = ["--id-keys", *CFG.id_keys, "--min-score", "0.9"]
    at = {n: f"{tmp_path}/{n}" for n in ("raw", "a", "b", "pairs", "matrix")}

    def run(*argv):
        return cli.run(spark, cli.parser().parse_args([*argv, *args]))

    single = {
        "raw": run("raw", landing, at["raw"], "--partition-by", "codigo_municipio"),
        "base_a": run("base-a", at["raw"], at["a"], "--partition-by", "codigo_municipio"),
        "base_b": run("base-b", at["a"], at["b"]),
        "pairs": run("matrix", at["a"], at["b"], at["pairs"], at["matrix"]),
    }
    assert single == counts
    assert counts["raw"]["rows_in"] == counts["raw"]["rows_out"] == 200
    assert counts["base_a"]["rows_in"] == 200 and counts["base_b"]["rows_in"] == counts["base_b"]["rows_out"]
    whole = spark.read.parquet(f"{tmp_path}/whole/matrix")
    assert sorted(spark.read.parquet(at["matrix"]).collect()) == sorted(whole.collect())
    assert whole.columns == ["id_a", "id_b", "score"]


def test_partitioned_raw_table_reads_back_the_same(spark, tmp_path):
    lines = spark.createDataFrame([("29" + "00500" + "x" * 200,), ("29",)], "value string")
    path = write_lines(lines, "short")
    plain, parted = f"{tmp_path}/plain", f"{tmp_path}/parted"
    cfg = linkage.LinkageConfig(partition_by=("codigo_uf", "codigo_municipio"))
    linkage.landing_to_raw(spark, path, plain)
    linkage.landing_to_raw(spark, path, parted, cfg)
    a = linkage.read_raw(spark, plain, linkage.LinkageConfig())
    b = linkage.read_raw(spark, parted, cfg)
    assert a.dtypes == b.dtypes and sorted(a.collect()) == sorted(b.collect())
    plan = b.filter("codigo_uf = '29'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan


def test_base_a_takes_all_rows_and_needs_id_keys(spark, landing):
    cfg = linkage.LinkageConfig(id_keys=CFG.id_keys, extraction_time=True)
    raw = linkage.parse_landing(spark, landing, cfg)
    base = linkage.build_base_a(raw, cfg)
    assert base.columns == ["id", *linkage.ADDRESS_COLUMNS, "extracted_at", linkage.COMPLEMENT]
    assert base.select("id").distinct().count() == base.count() == raw.filter(f"{linkage.CODE} = '27408'").count()
    cut = linkage.build_base_a(raw, linkage.LinkageConfig(id_keys=CFG.id_keys, limit=7))
    assert cut.count() == 7
    with pytest.raises(ValueError, match="id_keys"):
        linkage.build_base_a(raw, linkage.LinkageConfig())


def test_nothing_is_cut_from_a_large_base(spark):
    fields = [f.name for f in linkage.ADDRESS_LAYOUT]
    key = CFG.id_keys[0]
    raw = spark.range(100_500).select(
        *[
            (F.col("id").cast("string") if f == key else F.lit("27408" if f == linkage.CODE else "x")).alias(f)
            for f in fields
        ]
    )
    assert linkage.build_base_a(raw, CFG).count() == 100_500


def test_draws_do_not_depend_on_the_layout(spark, landing):
    cfg = linkage.LinkageConfig(id_keys=CFG.id_keys, fraction=0.5, limit=40)
    raw = linkage.parse_landing(spark, landing, cfg)
    bases = [sorted(linkage.build_base_a(raw.repartition(n), cfg).collect()) for n in (1, 4)]
    assert bases[0] == bases[1] and 0 < len(bases[0]) <= 40


def test_base_a_reads_only_what_it_needs(spark, landing, tmp_path):
    linkage.landing_to_raw(spark, landing, f"{tmp_path}/raw", CFG)
    base = linkage.build_base_a(linkage.read_raw(spark, f"{tmp_path}/raw", CFG), CFG)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(codigo_municipio,27408)" in plan
    assert "longitude" not in plan and "Exchange" not in plan and "Python" not in plan


def test_csv_keeps_nulls_apart_from_empty_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, 'a,"b"')], "i int, t string").coalesce(1)
    replace_csv(df, f"{tmp_path}/x")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/x").collect())
    assert lines == ["1,", '2,""', '3,"a,""b"""', "i,t"]
    back = read_extract(spark, f"{tmp_path}/x", schema="i int, t string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_replacing_writers(spark, tmp_path):
    five, three = spark.range(5), spark.range(3)
    for write, read in (
        (lambda d: replace_parquet(d, f"{tmp_path}/p"), lambda: spark.read.parquet(f"{tmp_path}/p")),
        (lambda d: replace_csv(d, f"{tmp_path}/c"), lambda: read_extract(spark, f"{tmp_path}/c")),
    ):
        write(five)
        write(three)
        assert read().count() == 3
    name = f"t_{uuid.uuid4().hex}"
    replace_table(five, name, f"{tmp_path}/t")
    replace_table(three.withColumnRenamed("id", "n"), name, f"{tmp_path}/t")
    assert spark.table(name).columns == ["n"] and spark.table(name).count() == 3


def test_parquet_is_snappy(spark, tmp_path):
    replace_parquet(spark.range(3), f"{tmp_path}/p")
    assert [f for f in (tmp_path / "p").iterdir() if f.name.endswith(".snappy.parquet")]


def test_jdbc_options():
    got = jdbc_options("jdbc:x:y", "t", {"user": "u"}, truncate=True)
    assert got["url"] == "jdbc:x:y" and got["dbtable"] == "t"
    assert got["truncate"] == "true" and got["user"] == "u" and got["numPartitions"] == "16"


def test_s3a_conf():
    conf = s3a_conf(endpoint="http://store", path_style=True)
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    with pytest.raises(ValueError):
        s3a_conf(colour="red")


def test_extracts(spark, tmp_path):
    one = spark.createDataFrame([(1, "m", 5)], "ID_MARCA int, MARCA string, QTD_VENDA int")
    two = spark.createDataFrame([(2, "n", "x")], "ID_MARCA int, MARCA string, other string")
    paths = [f"{tmp_path}/one", f"{tmp_path}/two"]
    replace_csv(one, paths[0])
    replace_csv(two, paths[1])
    got = extracts.unite_extracts(spark, paths, "csv", extracts.SALES_NAMES)
    assert got.columns == ["marca_id", "marca_name", "venda_quantity", "other"]
    assert sorted(map(tuple, got.collect())) == [("1", "m", "5", None), ("2", "n", None, "x")]
    typed = read_folder(spark, f"{tmp_path}", {"ID_MARCA": "int"})
    assert sorted(map(tuple, typed.collect())) == [(1, "m", "5", None), (2, "n", None, "x")]
    with pytest.raises(Exception):  # noqa: B017  columns in another order are an error, not shifted
        read_extract(spark, paths[0], schema="MARCA string, ID_MARCA int, QTD_VENDA int").collect()
    with pytest.raises(ValueError, match="xlsx"):
        read_extract(spark, paths[0], "xlsx")
    with pytest.raises(ValueError, match="no extract"):
        union_by_name([])


def test_counts(spark):
    got = stage_counts({"s": (spark.range(9), spark.range(4)), "t": (spark.range(2), spark.range(0))})
    assert sorted(map(tuple, got.collect())) == [("s", 9, 4), ("t", 2, 0)]
    df, watch = observed(spark.range(6), f"w{uuid.uuid4().hex}")
    df.select(F.sum("id")).collect()
    assert watch.get["rows"] == 6


def test_shared_folder(spark):
    root = session.shared_dir(spark)
    assert session.shared_dir(spark) == root == spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    df = session.materialise(spark.range(3), "x")
    assert df.count() == 3 and "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("argv", [[], ["raw"], ["raw", "only-one"], ["nothing", "a", "b"]])
def test_wrong_arguments_end_the_program(argv):
    with pytest.raises(SystemExit) as stop:
        cli.parser().parse_args(argv)
    assert stop.value.code != 0


def test_failed_writes_leave_the_old_rows(spark, tmp_path):
    """The write breaks off after some rows: readers still find what was there, and nothing else is left behind."""
    broken = spark.range(100).withColumn(
        "id", F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id"))
    )
    name = f"t_{uuid.uuid4().hex}"
    replace_parquet(spark.range(5), f"{tmp_path}/p")
    replace_csv(spark.range(5), f"{tmp_path}/c")
    replace_table(spark.range(5), name, f"{tmp_path}/t")
    for write in (
        lambda: replace_parquet(broken, f"{tmp_path}/p"),
        lambda: replace_csv(broken, f"{tmp_path}/c"),
        lambda: replace_table(broken, name, f"{tmp_path}/t"),
    ):
        with pytest.raises(Exception, match="broken"):
            write()
    assert spark.read.parquet(f"{tmp_path}/p").count() == 5
    assert read_extract(spark, f"{tmp_path}/c").count() == 5
    assert spark.table(name).count() == 5
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c", "p", "t"]


def test_rows_may_come_from_what_they_replace(spark, tmp_path):
    replace_parquet(spark.range(10), f"{tmp_path}/p")
    replace_parquet(spark.read.parquet(f"{tmp_path}/p").filter("id < 4"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4


def test_a_plain_table_is_replaced_and_old_versions_go(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    spark.range(9).write.option("path", f"{tmp_path}/plain").saveAsTable(name)
    for n in (1, 2, 3, 4):
        replace_table(spark.range(n), name, f"{tmp_path}/t")
        assert spark.table(name).count() == n
    assert len(list((tmp_path / "t").iterdir())) == 2


def test_headers_of_a_thousand_files_take_a_job_each_kind(spark, tmp_path):
    kinds = ["a,b", "b,a", "a,b,c", '"a","b d"']
    for k in range(1000):
        rows = "".join(f"{k},{i},x\n"[: len(f"{k},{i},x\n") - (2 if k % 4 != 2 else 0)].rstrip("\n,") + "\n" for i in range(2))
        (tmp_path / f"file {k:04d}.csv").write_text(kinds[k % 4] + "\n" + rows)
    (tmp_path / "empty.csv").write_text("")
    spark.sparkContext.setJobGroup("headers", "headers")
    df = read_folder(spark, str(tmp_path))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 3 + len(kinds)  # Spark lists the files of each header in a job too
    assert sorted(df.columns) == ["a", "b", "b d", "c"]
    counted = df.agg(F.count("*"), F.count("a"), F.count("b"), F.count("c"), F.count("b d")).first()
    assert tuple(counted) == (2000, 2000, 1500, 500, 500)
    assert df.filter("c = 'x' AND a = '2' AND b = '1'").count() == 1


def test_a_header_of_several_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"a\nb",c\n1,"2\n3"\n')
    df = read_folder(spark, str(tmp_path), multi_line=True)
    assert df.columns == ["a\nb", "c"] and [tuple(r) for r in df.collect()] == [("1", "2\n3")]


def test_scratch_is_empty_after_the_job(spark, landing, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(shared))
    counts = linkage.run_linkage(spark, landing, f"{tmp_path}/out", CFG)
    assert counts["pairs"]["rows_out"] > 0 and list(shared.iterdir()) == []
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        session.materialise(spark.range(3), "x")
        assert len(list(shared.iterdir())) == 1
        1 / 0
    assert list(shared.iterdir()) == []


def test_ids_by_position_do_not_depend_on_the_splits(spark, tmp_path):
    """Two files, cut into many splits, into few and read in other numbers of tasks."""
    (tmp_path / "in").mkdir()
    want = []
    for name in ("b 1.txt", "a.txt"):
        (tmp_path / "in" / name).write_text("".join("\n" if i % 10 == 3 else f"{name} {i}\n" for i in range(3000)))
    for name in ("a.txt", "b 1.txt"):
        want += [f"{name} {i}" if i % 10 != 3 else "" for i in range(3000)]
    want = [(v, k) for k, v in enumerate(want) if v]
    seen = []
    for size in ("4k", "100m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = read_numbered_lines(spark, str(tmp_path / "in"))
        seen.append(sorted((r.line, r.value) for r in lines.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == sorted((k, v) for v, k in want)


def test_the_job_without_keys_tells_records_by_their_line(spark, landing, tmp_path):
    cfg = linkage.LinkageConfig(line_ids=True, min_score=0.9)
    counts = linkage.run_linkage(spark, landing, f"{tmp_path}/out", cfg)
    base = spark.read.parquet(f"{tmp_path}/out/base_a")
    keyed = linkage.build_base_a(linkage.parse_landing(spark, landing, CFG), CFG)
    assert dict(base.dtypes)["id"] == "bigint" and base.select("id").distinct().count() == keyed.count()
    assert counts["base_b"]["rows_in"] == keyed.count() and spark.read.parquet(f"{tmp_path}/out/matrix").count() > 0
    args = cli.parser().parse_args(["raw", landing, f"{tmp_path}/raw", "--line-ids"])
    assert cli.run(spark, args) == counts["raw"]
