import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from molframe import catalog

DIR = "/root/testdata/sf0.001"


def test_positions_beyond_any_fixed_reference(spark, tmp_path):
    """Reads at 100,000 and more, as tables above SF 10 have them."""
    rows = pq.read_table(f"{DIR}/lineitem.parquet").slice(0, 500)
    at = rows.schema.get_field_index("l_suppkey")
    keys = [99_990 + 7 * i for i in range(500)]
    pq.write_table(rows.set_column(at, rows.schema.field(at), pa.array(keys, rows.schema.field(at).type)), tmp_path / "lineitem.parquet")
    df = catalog.queries()["methylation_counts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    rel = con.execute(catalog.oracle_sql()["methylation_counts"])
    names = [x[0] for x in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want and want[-1][names.index("pos")] > 100_000
