"""Schema registry: declared column types with primary and foreign keys.

Keys live in the field metadata, so they travel with the ``StructType`` and drive the
generated data-quality suite.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TYPES = {
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "FLOAT[]": T.ArrayType(T.FloatType()),
}


@dataclass
class SchemaRegistry:
    tables: dict[str, T.StructType] = field(default_factory=dict)

    @classmethod
    def from_config(cls, schema: dict) -> "SchemaRegistry":
        """``schema`` has the shape of the ``schema`` block of a YAML project file."""
        tables = {}
        for table, body in schema.items():
            fields = []
            for column in body["columns"]:
                keys = {k: column[k] for k in ("pk", "fk") if column.get(k)}
                fields.append(T.StructField(column["name"], TYPES[column["type"]], True, keys))
            tables[table] = T.StructType(fields)
        return cls(tables)

    @classmethod
    def from_text(cls, text: str) -> "SchemaRegistry":
        """One table per line: ``name: column TYPE [pk] [fk=table.column], …``."""
        schema = {}
        for line in filter(None, map(str.strip, text.splitlines())):
            table, columns = line.split(":", 1)
            schema[table] = {"columns": []}
            for column in columns.split(","):
                name, kind, *keys = column.split()
                spec = {"name": name, "type": kind, "pk": "pk" in keys}
                spec.update(k.split("=") for k in keys if "=" in k)
                schema[table]["columns"].append(spec)
        return cls.from_config(schema)

    def schema(self, table: str) -> T.StructType:
        return self.tables[table]

    def columns(self, table: str) -> list[str]:
        return self.tables[table].names

    def primary_keys(self, table: str) -> list[str]:
        return [f.name for f in self.tables[table] if f.metadata.get("pk")]

    def foreign_keys(self, table: str) -> dict[str, str]:
        return {f.name: f.metadata["fk"] for f in self.tables[table] if f.metadata.get("fk")}

    def to_json(self) -> dict[str, str]:
        return {table: schema.json() for table, schema in self.tables.items()}


# The retail model: one fact and two dimensions, delivered as CSV.
RETAIL = SchemaRegistry.from_text("""
orders: order_id INTEGER pk, order_date DATE, customer_id INTEGER fk=customers.customer_id, product_id INTEGER fk=products.product_id, quantity INTEGER, price DOUBLE, region VARCHAR
customers: customer_id INTEGER pk, customer_name VARCHAR, segment VARCHAR, state VARCHAR, signup_date DATE
products: product_id INTEGER pk, product_name VARCHAR, category VARCHAR, cost DOUBLE
""")

# The Parquet tables of the star schema this repository is tested on.
STAR = SchemaRegistry.from_text("""
region: r_regionkey INTEGER pk, r_name VARCHAR
nation: n_nationkey INTEGER pk, n_name VARCHAR, n_regionkey INTEGER fk=region.r_regionkey
customer: c_custkey BIGINT pk, c_name VARCHAR, c_nationkey INTEGER fk=nation.n_nationkey, c_acctbal DOUBLE, c_mktsegment VARCHAR
supplier: s_suppkey BIGINT pk, s_name VARCHAR, s_nationkey INTEGER fk=nation.n_nationkey, s_acctbal DOUBLE
part: p_partkey BIGINT pk, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE
orders: o_orderkey BIGINT pk, o_custkey BIGINT fk=customer.c_custkey, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority VARCHAR
lineitem: l_orderkey BIGINT fk=orders.o_orderkey, l_partkey BIGINT fk=part.p_partkey, l_suppkey BIGINT fk=supplier.s_suppkey, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP_NTZ
events: event_id BIGINT pk, ts TIMESTAMP_NTZ, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR
documents: doc_id BIGINT pk, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT
embeddings: vec_id BIGINT pk, embedding FLOAT[], label INTEGER
pages: page_id BIGINT pk, url VARCHAR, html VARCHAR
benchmark: item_id BIGINT pk, text VARCHAR
labels: doc_id BIGINT pk fk=documents.doc_id, quality INTEGER, toxic INTEGER
conversations: conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR
""")
