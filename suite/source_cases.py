"""Readers, writers and versions: tables make a round trip through files."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime, timedelta
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from gritstone.operators.cleaning import clean
from gritstone.runtime import materialize, scratch_path, share_package
from gritstone.sources.reader import export, read_dataset, type_columns
from gritstone.sources.versions import VersionStore
from gritstone.sources.workbook import workbook_rows
from suite.base import CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS, case, dirty_customer, per_column_sql, table

# Texts that a delimited reader takes for missing values.
GAPS = "case when c_mktsegment in ('', 'n/a') then null else c_mktsegment end as c_mktsegment"


@case(
    "scan_csv",
    f"select * replace ({GAPS}) from {CUSTOMER_SQL} where c_custkey is not null",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "csv") + ".csv"
    export(dirty_customer(spark, sf_dir).where("c_custkey is not null"), path, "csv")
    return read_dataset(spark, path)


@case("scan_csv_multiline", "select doc_id, text, lang, source, n_chars from documents")
def _(spark, sf_dir):
    path = scratch_path(spark, "multiline") + ".csv"
    export(table(spark, sf_dir, "documents"), path, "csv")
    return read_dataset(spark, path)


@case("scan_tsv", "select * replace (cast(o_orderdate as varchar) as o_orderdate) from orders")
def _(spark, sf_dir):
    path = scratch_path(spark, "tsv") + ".tsv"
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    export(orders, path, "tsv")
    return read_dataset(spark, path)


@case("scan_parquet", "select * from lineitem")
def _(spark, sf_dir):
    return read_dataset(spark, f"{sf_dir}/lineitem.parquet")


@case("scan_json", "select * replace (cast(p_size as bigint) as p_size) from part")
def _(spark, sf_dir):
    path = scratch_path(spark, "array")
    part = table(spark, sf_dir, "part")

    def arrays(batches):
        for batch in batches:
            yield batch.groupby(lambda _: 0).apply(lambda b: b.to_json(orient="records")).to_frame("value")

    # Every batch becomes one file line that is a JSON array.
    part.mapInPandas(arrays, "value string").write.text(path)
    return read_dataset(spark, path, "json").select(*part.columns)


@case("scan_jsonl", "select * replace (cast(ts as varchar) as ts) from events")
def _(spark, sf_dir):
    path = scratch_path(spark, "lines") + ".jsonl"
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string"))
    export(events, path, "jsonl")
    return read_dataset(spark, path).select(*events.columns)


@case("scan_latin1", "select doc_id, lang || ' é' as lang, source from documents")
def _(spark, sf_dir):
    path = scratch_path(spark, "latin1") + ".csv"
    documents = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(lang, ' é') as lang", "source")
    documents.write.option("encoding", "ISO-8859-1").csv(path, header=True)
    return read_dataset(spark, path)


def workbook(names: list[str], rows) -> bytes:
    """A minimal workbook with one sheet of inline texts, numbers and date-times."""
    def cell(value) -> str:
        if isinstance(value, datetime):
            return f'<c s="1"><v>{(value - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [names, *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd&quot; at &quot;hh:mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{package}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
    return out.getvalue()


def books(spark, df, name: str, columns: list[str]):
    """Workbooks with the given columns of a table, one per batch, as ``path, content``."""
    share_package(spark)

    def pack(batches):
        for i, batch in enumerate(b for b in batches if len(b)):
            rows = batch[columns].astype(object).where(batch[columns].notna(), "").values.tolist()
            yield pd.DataFrame({"path": [f"{name}-{rows[0][0]}-{i}"], "content": [workbook(columns, rows)]})

    tasks = max(2, spark.sparkContext.defaultParallelism)
    return materialize(df.repartition(tasks, df.columns[0]).mapInPandas(pack, "path string, content binary"))


@case("scan_xlsx", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return type_columns(workbook_rows(books(spark, customer, "a", customer.columns)))


@case(
    "scan_xlsx_mixed",
    "select c_custkey, c_name, c_acctbal, null as c_mktsegment from customer union all"
    " select c_custkey, c_name, null, c_mktsegment from customer",
)
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    first = books(spark, customer, "a", ["c_custkey", "c_name", "c_acctbal"])
    second = books(spark, customer, "b", ["c_mktsegment", "c_name", "c_custkey"])
    return type_columns(workbook_rows(first.unionByName(second))).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@case("scan_xlsx_dates", "select o_orderkey, cast(o_orderdate as timestamp) as o_orderdate, o_totalprice, o_orderstatus from orders")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return type_columns(workbook_rows(books(spark, orders, "o", ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"])))


def stored(spark, sf_dir):
    """A dataset with its cleaned table promoted to version 2."""
    store = VersionStore(spark, scratch_path(spark, "store"))
    source = dirty_customer(spark, sf_dir)
    dataset = store.create(source, "customer.parquet", "ds_customer")
    clean(source).approve(store, dataset)
    return store, dataset


@case("version_create", f"select 'ds_customer' as dataset_id, cast(1 as int) as version, count(*) as row_count, cast(7 as bigint) as column_count from {CUSTOMER_SQL}")
def _(spark, sf_dir):
    store = VersionStore(spark, scratch_path(spark, "store"))
    store.create(dirty_customer(spark, sf_dir), "customer.parquet", "ds_customer")
    return store.list().select("dataset_id", "version", "row_count", "column_count")


@case("version_promote", f"select cast(2 as int) as version, 'Approved cleaning run' as label, count(*) as row_count, cast(8 as bigint) as column_count from (select distinct * from {CUSTOMER_SQL})")
def _(spark, sf_dir):
    store, _ = stored(spark, sf_dir)
    return store.list().where("version = 2").select("version", "label", "row_count", "column_count")


@case("version_read", f"select * from {CUSTOMER_SQL}")
def _(spark, sf_dir):
    store, dataset = stored(spark, sf_dir)
    return store.read(dataset, 1)


@case(
    "version_list",
    f"""select 'Original upload' as label, cast(1 as int) as version, count(*) as row_count, cast(7 as bigint) as column_count from {CUSTOMER_SQL}
    union all select 'Approved cleaning run', 2, count(*), 8 from (select distinct * from {CUSTOMER_SQL})""",
)
def _(spark, sf_dir):
    store, _ = stored(spark, sf_dir)
    return store.list().select("label", "version", "row_count", "column_count")


@case(
    "version_profile",
    per_column_sql(CUSTOMER_SQL, DIRTY_CUSTOMER_COLUMNS, lambda n, k: f"count(*) - count({n}) as null_count, count(distinct {n}) as unique_count"),
)
def _(spark, sf_dir):
    store = VersionStore(spark, scratch_path(spark, "store"))
    dataset = store.create(dirty_customer(spark, sf_dir), "customer.parquet", profiled=True)
    return store.profile(dataset, 1).select("position", "column", "null_count", "unique_count")


@case(
    "version_compare",
    f"""with a as (select count(*) as n from {CUSTOMER_SQL}), b as (select count(*) as n from (select distinct * from {CUSTOMER_SQL}))
    select cast(1 as int) as version, n as row_count, cast(0 as bigint) as row_delta, cast(0 as bigint) as column_delta from a
    union all select 2, b.n, b.n - a.n, 1 from a, b""",
)
def _(spark, sf_dir):
    store, dataset = stored(spark, sf_dir)
    return store.version_compare(dataset).select("version", "row_count", "row_delta", "column_delta")


@case("export_roundtrip", "select * replace (cast(c_nationkey as bigint) as c_nationkey) from customer union all select * replace (cast(c_nationkey as bigint) as c_nationkey) from customer")
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    back = []
    for kind in ("csv", "json"):
        path = scratch_path(spark, "export") + f".{kind}"
        export(customer, path, kind)
        back.append(read_dataset(spark, path, "csv" if kind == "csv" else "jsonl").select(*customer.columns))
    return back[0].unionByName(back[1])


@case("run_artifacts", f"select count(*) as n, count(email) as emails from (select distinct * from {CUSTOMER_SQL})")
def _(spark, sf_dir):
    path = scratch_path(spark, "run")
    clean(dirty_customer(spark, sf_dir)).write(path)
    written = read_dataset(spark, f"{path}/cleaned.parquet")
    return written.selectExpr("count(*) as n", "count(email) as emails")
