from __future__ import annotations

import hashlib
import pathlib
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks import spark_queries
from claimspark.functions.privacy import mask_pii, mask_record, mask_text
from claimspark.operators.quality import (
    EMPTY_WARNING,
    constraint_report,
    evidence_pack,
    null_profile,
    sort_columns,
    top_rows,
    validate_result,
)
from claimspark.sources.layout import interleaved, read_claims, read_eligibility, write_claims, write_claims_interleaved, write_eligibility
from claimspark.sources.load import keep_first, load_rejects, load_tables, new_rows, null_tokens, scan_csv, split_rejects, table_counts
from claimspark.sources.records import placed_records
from claimspark.sources.schemas import SCHEMAS
from claimspark.streaming.ingest import append_new, create_target, ingest, target_rows
from claimspark.streaming.membership import BUCKET, LOAD, add_to_index, create_index, key_bucket, parts_that_may_hold


def test_mask_columns(spark):
    df = spark.createDataFrame([("987-65-4320", 7, "Zoë"), (None, 8, None)], "Ssn string, units int, LAST_name string")
    assert [tuple(r) for r in mask_pii(df).collect()] == [("***REDACTED***", n, "***REDACTED***") for n in (7, 8)]


def test_mask_record():
    masked = mask_record({"SSN": "987-65-4320", "units": 4, "last_name": None})
    assert masked == {"SSN": "***REDACTED***", "units": 4, "last_name": "***REDACTED***"}


@pytest.mark.parametrize("text, masked", [
    ("Number 987-65-4320, two doors from no. 17", "Number ***-**-****, two doors from no. 17"),
    ("555.123.4567", "***-***-****"),
    ("call 555-123-4567 or 555) 123-4567, 555.123.45678", "call ***-***-**** or ***-***-****, 555.123.45678"),
    ("x123-45-6789 é123-45-6789 1234-56-7890 123-45-6789é", "x123-45-6789 é123-45-6789 1234-56-7890 123-45-6789é"),
    ("١٢٣-٤٥-٦٧٨٩", "***-**-****"),
    ("555- 123- 4567", "***-***-****"),
    ("123-45-6789-123-45-6789", "***-**-****-***-**-****"),
    ("555-123-45-6789", "555-***-**-****"),
    (None, None),
])
def test_mask_text(spark, text, masked):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mask_text(F.col("t"))).first()[0] == masked


def test_null_profile(spark):
    data = [(None if i < 51 else 1, None if i < 50 else 1, 1) for i in range(100)]
    found = {r["column"]: r for r in null_profile(spark.createDataFrame(data, "a int, b int, c int")).collect()}
    assert found["a"].null_pct == 51.0 and found["a"].is_warning
    assert found["a"].warning == "Column 'a' is 51% null — data may be incomplete"
    assert not found["b"].is_warning and found["b"].warning is None and found["c"].null_pct == 0.0


def test_validate_result(spark):
    empty = spark.createDataFrame([], "phone string, n int")
    masked, warnings = validate_result(empty)
    assert masked.count() == 0 and [r.warning for r in warnings.collect()] == [EMPTY_WARNING]
    masked, warnings = validate_result(spark.createDataFrame([("5", None)], "phone string, n int"))
    assert masked.first().phone == "***REDACTED***"
    assert [r.warning for r in warnings.collect()] == ["Column 'n' is 100% null — data may be incomplete"]


def test_evidence_is_masked_counted_and_cut(spark):
    data = [("A", i, f"Name{i}", None) for i in range(25)] + [("B", 1, "Name", 2.5)]
    df = spark.createDataFrame(data, "provider_npi string, n int, full_name string, x double")
    pack = evidence_pack({"some": df}, {"some": sort_columns(["-n"])})
    a, b = sorted(pack.collect(), key=lambda r: r.provider_npi)
    assert (a.concept, a.row_count, len(a.sample)) == ("some", 25, 20)
    assert a.sample[0] == '{"n":24,"full_name":"***REDACTED***","x":null}'
    assert a.warnings == ["Column 'x' is 100% null — data may be incomplete"] and b.warnings == []
    asked = spark.createDataFrame([("A",), ("C",)], "provider_npi string")
    found = {r.provider_npi: r for r in evidence_pack({"some": df}, {"some": sort_columns(["-n"])}, asked=asked).collect()}
    assert set(found) == {"A", "B", "C"} and (found["C"].row_count, found["C"].warnings, found["C"].sample) == (0, [EMPTY_WARNING], [])
    assert "Name" not in "".join(a.sample + b.sample)


def test_top_rows(spark):
    df = spark.range(6000).toDF("n")
    found = top_rows(df, sort_columns(["-n"])).collect()
    assert len(found) == 5000 and found[0].n == 5999


def test_constraints(build):
    tables = build(
        providers=[{"npi": "A"}, {"npi": "A"}, {"npi": None}],
        members=[{"member_id": "M1"}],
        claims=[{}, {"claim_id": "C0", "member_id": "X"}, {"provider_npi": "Z"}, {"provider_npi": None}],
    )
    found = {(r.constraint, r.table, r.columns): r.violations for r in constraint_report(tables).collect()}
    assert found["primary_key", "providers", "npi"] == 2
    assert found["primary_key", "claims", "claim_id"] == 1
    assert found["foreign_key", "claims", "member_id"] == 1
    assert found["foreign_key", "claims", "provider_npi"] == 1
    assert found["primary_key", "eligibility", "eligibility_id"] == 0


ELIGIBILITY = "eligibility_id,member_id,coverage_start,coverage_end,plan_code,coverage_type,status,created_date\n"


@pytest.fixture
def csv_folder(tmp_path):
    (tmp_path / "providers.csv").write_text(
        "npi,first_name,last_name,specialty,practice_state,practice_city,practice_zip,tax_id,practice_type,enrollment_date,is_active\n"
        '0012345678,"Ann, B",NULL,IM,TX,,01234,"",solo,2020-01-01,True\n'
        "0012345678,Later,X,IM,TX,Austin,01234,1,solo,2020-01-01,False\n"
        "2,Bad,Date,IM,TX,Austin,1,1,solo,soon,True\n"
        "3,Short,row\n"
        "4,Null,Date,IM,TX,Austin,1,1,solo,NULL,\n"
    )
    (tmp_path / "eligibility.csv").write_text(ELIGIBILITY + "E1,M1,2025-01-01,2025-12-31,P,medical,active,2025-01-01\n")
    return tmp_path


def test_load(spark, csv_folder, caplog):
    tables = load_tables(spark, str(csv_folder))
    assert set(tables) == {"providers", "eligibility"}
    assert "claims" in caplog.text
    found = {r.npi: r for r in tables["providers"].collect()}
    assert set(found) == {"0012345678", "4"}
    first = found["0012345678"]
    assert (first.first_name, first.last_name, first.practice_city, first.tax_id) == ("Ann, B", None, None, None)
    assert first.practice_zip == "01234" and first.is_active is True and first.enrollment_date == date(2020, 1, 1)
    assert found["4"].enrollment_date is None and found["4"].is_active is None
    assert tables["providers"].select("npi").count() == 2, "a bad row is left out whatever is selected"
    rejects = load_rejects(spark, "providers", f"{csv_folder}/providers.csv")
    assert sorted(r.line[:1] for r in rejects.collect()) == ["2", "3"]
    assert {r.tbl: r.rows for r in table_counts(tables).collect()} == {"providers": 2, "eligibility": 1}


def test_null_tokens(spark):
    df = spark.createDataFrame([("", 1), ("NULL", 2), ("null", 3), (" ", 4), (None, 5)], "s string, n int")
    assert [r.s for r in null_tokens(df).orderBy("n").collect()] == [None, None, "null", " ", None]


def test_keep_first_and_new_rows(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "c"), (3, "z")], "k int, v string")
    assert rows(keep_first(df, ["k"])) == [(1, "a"), (2, None), (3, "z")]
    existing = spark.createDataFrame([(1, "old")], "k int, v string")
    assert rows(new_rows(df, existing, ["k"])) == [(2, None), (3, "z")]


def test_rank_limit_runs_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 2 as k", "id as v")
    plan = keep_first(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_layout(build, spark, tmp_path, rows):
    days = ("2024-12-31", "2025-01-01", "2025-01-31", "2025-02-01", None)
    tables = build(claims=[{"service_date": d} for d in days],
                   eligibility=[{"eligibility_id": "E", "member_id": "M", "coverage_start": "2025-01-01"}, {"eligibility_id": "F"}])
    write_claims(tables["claims"], f"{tmp_path}/claims", files=2)
    assert rows(read_claims(spark, f"{tmp_path}/claims")) == rows(tables["claims"])
    january = read_claims(spark, f"{tmp_path}/claims", "2025-01-01", "2025-01-31")
    assert january.count() == 2
    assert "PartitionFilters: [isnotnull(service_month" in january._jdf.queryExecution().executedPlan().toString()
    write_eligibility(tables["eligibility"], f"{tmp_path}/eligibility")
    assert rows(read_eligibility(spark, f"{tmp_path}/eligibility")) == rows(tables["eligibility"])


def _rows_scanned(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_interleaved_layout_skips_by_either_key(spark, tmp_path):
    # 40,000 claims of a month; provider P0 has a third of them, two have no member
    claims = spark.range(40_000).selectExpr(
        "concat('C', id) claim_id", "if(id % 3 = 0, 'P0', concat('P', pmod(xxhash64(id), 900))) provider_npi",
        "if(id < 2, null, concat('M', pmod(xxhash64(id, 1), 3000))) member_id", "date '2025-01-01' + cast(id % 31 as int) service_date",
    )
    small = {"parquet.page.row.count.limit": "64", "parquet.block.size": "65536", "parquet.block.size.row.check.min": "10"}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in small.items():
        conf.set(name, value)
    try:
        write_claims_interleaved(claims, f"{tmp_path}/both", 4)
        write_claims(claims, f"{tmp_path}/one", 4)
    finally:
        for name in small:
            conf.unset(name)
    both, one = (read_claims(spark, f"{tmp_path}/{name}", "2025-01-01", "2025-01-31") for name in ("both", "one"))
    assert both.exceptAll(claims).count() == 0 and both.count() == 40_000
    for member in ("M7", "M1500", "M2999"):
        picked = both.where(F.col("member_id") == member)
        assert picked.exceptAll(claims.where(F.col("member_id") == member)).count() == 0
        assert _rows_scanned(both.where(F.col("member_id") == member)) <= 4_000
        assert _rows_scanned(one.where(F.col("member_id") == member)) > 20_000
    assert _rows_scanned(both.where("provider_npi = 'P450'")) <= 4_000
    assert _rows_scanned(both.where("provider_npi = 'P0' and member_id = 'M7'")) <= 2_000


def test_interleaved_layout_of_unusual_tables(build, spark, tmp_path, rows):
    claims = build(claims=[{"service_date": d, "member_id": m, "provider_npi": p} for d, m, p in
                           [(None, None, None), ("2025-01-01", "M", None), ("2025-01-01", "M", None)]])["claims"]
    write_claims_interleaved(claims, f"{tmp_path}/odd", bits=1)
    assert rows(read_claims(spark, f"{tmp_path}/odd")) == rows(claims)
    write_claims_interleaved(claims.limit(0), f"{tmp_path}/none")
    assert spark.read.schema(claims.schema).parquet(f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        write_claims_interleaved(claims, f"{tmp_path}/odd", bits=13)


def test_bits_in_turn(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    found = cells.select("x", "y", interleaved([F.col("x"), F.col("y")], 3).alias("z")).collect()
    for x, y, z in found:
        assert z == int("".join(a + b for a, b in zip(f"{x:03b}", f"{y:03b}")), 2)


MAP = "procedure_code,expected_specialty,category\n"


def test_columns_by_header_name(spark, tmp_path, caplog):
    (tmp_path / "specialty_procedure_map.csv").write_text("Category,extra,expected_specialty,PROCEDURE_CODE\nsurg,1,Ortho,27447\n")
    (tmp_path / "specialty_procedure_map.csv.bak").write_text(MAP + "a,b,c\n")
    found = load_tables(spark, str(tmp_path), ["specialty_procedure_map"])["specialty_procedure_map"]
    assert [r.asDict() for r in found.collect()] == [{"procedure_code": "27447", "expected_specialty": "Ortho", "category": "surg"}]
    assert "extra" in caplog.text


def test_files_with_other_orders_are_read_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "specialty_procedure_map.csv"
    folder.mkdir()
    (folder / "a, b%20[1].csv").write_text("\n \n" + MAP + "1,2,3\n")
    (folder / "b c.csv").write_text("\ufeffcategory,expected_specialty,procedure_code\r\n3,2,11\r\n")
    (folder / "c.csv").write_text("value,CATEGORY,_place,procedure_code,_row\nv,z,w,12,x\n")
    (folder / "d.csv").write_text("")
    found = load_tables(spark, str(tmp_path), ["specialty_procedure_map"])["specialty_procedure_map"]
    assert sorted(tuple(str(v) for v in r) for r in found.collect()) == [("1", "2", "3"), ("11", "2", "3"), ("12", "None", "z")]
    (folder / "e.csv").write_text("no,names\n1,2\n")
    with pytest.raises(ValueError, match="not a header"):
        load_tables(spark, str(tmp_path), ["specialty_procedure_map"])


def test_the_first_line_of_a_key_stays(spark, tmp_path):
    folder = tmp_path / "specialty_procedure_map.csv"
    folder.mkdir()
    many = "".join(f"{n},z,{n}\n" for n in range(5000))
    (folder / "a.csv").write_text(MAP + many + "k,a,later\n1,z,late\n")
    (folder / "b.csv").write_text("category,expected_specialty,procedure_code\nfirst of b,a,k2\nsecond of file b,a,k\nalso,z,1\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = load_tables(spark, str(tmp_path), ["specialty_procedure_map"])["specialty_procedure_map"]
        assert found.count() == 5002
        by = {r.procedure_code: r.category for r in found.where("procedure_code in ('k', 'k2', '1')").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert by == {"k": "later", "k2": "first of b", "1": "1"}


@pytest.mark.parametrize("size, number", [(64, 8), (700, 120), (1 << 20, 120)])
def test_records_with_line_breaks_are_cut_at_any_block_size(spark, tmp_path, size, number):
    """Equal to Spark's own reader of such files, which has one task a file."""
    rng = random.Random(size)
    folder = tmp_path / "specialty_procedure_map.csv"
    folder.mkdir()
    for file in range(3):
        rows = []
        for n in range(number):
            kind = rng.random()
            text = "plain" if kind < 0.5 else '"' + "\n".join("x" * rng.randint(0, 40) + rng.choice(["", '""', ","]) for _ in range(rng.randint(1, 12))) + '"'
            rows.append(f"{file}-{n},{text},c")
        (folder / f"{file}.csv").write_text(MAP + "\n".join(rows) + "\n")
    (folder / "open.csv").write_text(MAP + 'o1,a,b\no2,"a,b\no3,a,b\n')
    schema = "procedure_code string, expected_specialty string, category string"
    plain = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(f"{folder}/[0-9].csv")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        scanned = scan_csv(spark, "specialty_procedure_map", str(folder), multi_line=True)
        tasks = placed_records(spark, str(folder)).rdd.getNumPartitions()
        good, bad = split_rejects(scanned)
        found = sorted(tuple(r) for r in good.drop("_place").collect())
        rejects = [r.line for r in bad.collect()]
        places = [tuple(r["_place"]) for r in scanned.select("_place").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert found == sorted([tuple(r) for r in plain.collect()] + [("o1", "a", "b"), ("o3", "a", "b")])
    assert rejects == ['o2,"a,b'] and len(set(places)) == len(places) == 3 * number + 3
    assert tasks > 4 or size > 700


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "specialty_procedure_map.csv"
    path.write_text(MAP + "".join(f'{n},"two\nlines",c\n' for n in range(2000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        scanned = scan_csv(spark, "specialty_procedure_map", str(path), multi_line=True)
        assert scanned.rdd.getNumPartitions() >= 5
        assert scanned.where("expected_specialty = 'two\nlines'").count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_documents_with_line_breaks_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task of ``load_line_breaks`` writes all documents, and what is read back is whole."""
    texts = {n: f'line {n}\n"quoted", next\n' * (n % 4) for n in range(40)}
    docs = spark.createDataFrame([(n, t, "web") for n, t in texts.items()], "doc_id long, text string, source string")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(spark_queries, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    found = {int(r.procedure_code): (r.n_chars, r.sha256) for r in spark_queries.texts_with_line_breaks(spark, str(tmp_path)).collect()}
    assert found == {n: (len(t), hashlib.sha256(t.encode()).hexdigest()) if t else (None, None) for n, t in texts.items()}
    assert len(list(tmp_path.glob("csv/specialty_procedure_map.csv/part-*"))) > 1


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "specialty_procedure_map.csv"
    path.write_text(MAP + '27447,Ortho,"a\nb"\n2,"x ""y""",c\n')
    load = lambda **how: sorted(tuple(r) for r in load_tables(spark, str(tmp_path), ["specialty_procedure_map"], **how)["specialty_procedure_map"].collect())
    assert load() == [("2", 'x "y"', "c")]
    assert sorted(r.line for r in load_rejects(spark, "specialty_procedure_map", str(path)).collect()) == ['27447,Ortho,"a', 'b"']
    assert load(multi_line=True) == [("2", 'x "y"', "c"), ("27447", "Ortho", "a\nb")]
    assert load_rejects(spark, "specialty_procedure_map", str(path), multi_line=True).count() == 0


def test_rows_without_a_key_stay_and_are_loaded_once(spark, rows):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d")], "k int, v string")
    assert rows(keep_first(df, ["k"])) == [(1, "c"), (None, "a"), (None, "b")]
    assert rows(new_rows(df, df.where("v = 'a'"), ["k"])) == [(1, "c"), (None, "b")]
    assert rows(new_rows(df, df, ["k"])) == []


def stored_keys(spark, tmp_path, loads, each, buckets):
    """A target of ``loads`` loads with ``each`` keys, entered in its index."""
    target, index = f"{tmp_path}/out", f"{tmp_path}/out.index"
    keys = spark.range(loads * each).select(
        F.concat(F.lit("E"), F.xxhash64("id")).alias("eligibility_id"), (F.col("id") % loads).cast("int").alias(LOAD),
        *[F.sha2(F.concat(F.lit(name), F.col("id")), 256).alias(name) for name in ("member_id", "plan_code", "coverage_type", "status")],
    )
    rows = keys.withColumn(BUCKET, key_bucket(["eligibility_id"], buckets)).cache()
    create_target(spark, "eligibility", target, index)
    rows.repartition(8, BUCKET).write.mode("append").partitionBy(BUCKET, LOAD).parquet(target)
    add_to_index(rows, ["eligibility_id"], index)
    return target, index, rows


def size_of(folder):
    return sum(f.stat().st_size for f in pathlib.Path(folder).rglob("*.parquet"))


def test_a_batch_reads_few_of_many_parts(spark, tmp_path):
    target, index, rows = stored_keys(spark, tmp_path, 16, 12_800, 64)
    new = spark.range(1000).select(F.concat(F.lit("E"), F.xxhash64(F.lit("new"), "id")).alias("eligibility_id"))
    batch = new.withColumn(BUCKET, key_bucket(["eligibility_id"], 64))
    parts = parts_that_may_hold(spark, index, batch, ["eligibility_id"])
    read = sum(size_of(f"{target}/{BUCKET}={bucket}/{LOAD}={load}") for load, bucket in parts) + size_of(index)
    assert len(list(pathlib.Path(target).rglob("*.parquet"))) >= 1000 and read < 0.05 * size_of(target)
    known = rows.where("load in (3, 7)").orderBy("eligibility_id").limit(10)
    parts = set(parts_that_may_hold(spark, index, known.select("eligibility_id", BUCKET), ["eligibility_id"]))
    assert {(r[LOAD], r[BUCKET]) for r in known.collect()} <= parts and len(parts) < 40


def test_the_index_never_misses_a_key(spark, tmp_path):
    target, index, rows = stored_keys(spark, tmp_path, 3, 400, 4)
    some = rows.where("load = 1").select("eligibility_id", BUCKET)
    more = some.unionByName(spark.createDataFrame([(None, 0), ("zzz", 1), ("A", 2)], "eligibility_id string, key_bucket int"))
    assert {(1, b) for b in range(4)} <= set(parts_that_may_hold(spark, index, more, ["eligibility_id"]))
    incoming = spark.createDataFrame([{}], "x int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["eligibility"].fields])
    incoming = incoming.unionByName(rows.where("load = 2").select("eligibility_id"), allowMissingColumns=True)
    for again in (False, True):  # a row without a key, and 400 that are there
        parts = append_new(spark, "eligibility", incoming, target, index, 4)
        assert target_rows(spark, "eligibility", target).count() == 1201
    # two keys in a key: a null in it is a value of the index
    two = spark.createDataFrame([("a", None, 0, 0), (None, "b", 0, 0)], f"x string, y string, {BUCKET} int, {LOAD} int")
    create_index(spark, f"{tmp_path}/two")
    add_to_index(two, ["x", "y"], f"{tmp_path}/two")
    for row in (["a", None], [None, "b"]):
        one = spark.createDataFrame([(*row, 0)], f"x string, y string, {BUCKET} int")
        assert parts_that_may_hold(spark, f"{tmp_path}/two", one, ["x", "y"]) == [(0, 0)]


def test_a_repeated_batch_replaces_its_rejects(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text(ELIGIBILITY + ",M,2025-01-01,2025-12-31,P,m,a,2025-01-01\nE9,M,soon,2025-12-31,P,m,a,2025-01-01\n")
    for mark in ("one", "two"):  # without its checkpoint the same batch is run again
        ingest(spark, "eligibility", str(source), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/{mark}").awaitTermination()
    assert spark.read.text(f"{tmp_path}/bad").count() == 1
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_ingest_loads_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    run = lambda: ingest(spark, "eligibility", str(source), target, f"{tmp_path}/bad", f"{tmp_path}/mark").awaitTermination()
    row = "{},M,2025-01-01,2025-12-31,P,medical,active,2025-01-01\n"
    (source / "a.csv").write_text(ELIGIBILITY + row.format("E1") + row.format("E1") + "E9,M,soon,2025-12-31,P,m,a,2025-01-01\n")
    run()
    (source / "b.csv").write_text(ELIGIBILITY + row.format("E1") + row.format("E2"))
    run()
    run()
    assert sorted(r.eligibility_id for r in spark.read.parquet(target).collect()) == ["E1", "E2"]
    assert spark.read.text(f"{tmp_path}/bad").count() == 1
