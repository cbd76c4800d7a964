"""Command line: load the retail CSV files and build the marts.

    python -m tallywork.etl --raw data/raw --out data/marts [--as-of 2024-12-31]
    python -m tallywork.etl --config project.yaml [--out data/marts]

A configuration file has ``project.datasets`` (paths of CSV files, each a table named like the file), ``project.warehouse_path`` (the
folder of the marts, a file extension is dropped) and ``schema`` (columns with types and keys, see ``SchemaRegistry.from_config``).
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions.numbers import as_money
from tallywork.plans.warehouse import build_marts, extract_all
from tallywork.schema import RETAIL, SchemaRegistry
from tallywork.session import build_session, new_folder
from tallywork.sources import io
from tallywork.sources.retail import retail_sales


def read_config(path: str) -> tuple[dict[str, str], str, SchemaRegistry]:
    """Dataset paths by table, the warehouse folder, and the schema of a project file."""
    import yaml  # only needed here

    with open(path, encoding="utf-8") as file:
        config = yaml.safe_load(file)
    project = config["project"]
    paths = {os.path.splitext(os.path.basename(p))[0]: p for p in project["datasets"]}
    return paths, os.path.splitext(project["warehouse_path"])[0], SchemaRegistry.from_config(config["schema"])


def run_etl(
    spark: SparkSession, raw_dir: str, out_dir: str, as_of: dt.date | None = None,
    paths: dict[str, str] | None = None, registry: SchemaRegistry = RETAIL,
) -> tuple[DataFrame, DataFrame | None]:
    """Extraction report, and the mart report (None when a source table is missing).

    Every CSV file is parsed once and landed as Parquet in the shared folder.
    """
    if paths is None:
        paths = {name: os.path.join(raw_dir, f"{name}.csv") for name in registry.tables}
    datasets = {
        name: lambda name=name, path=path: io.scan_csv(spark, path, schema=registry.tables.get(name))
        for name, path in paths.items()
    }
    tables, extracted = extract_all(spark, datasets, land=new_folder(spark, "landed"))
    if not set(RETAIL.tables) <= set(tables):
        return extracted, None
    as_of = as_of or tables["orders"].agg(F.max("order_date")).first()[0]
    products = tables["products"].select(
        "product_id", "product_name",
        F.col("category").alias("product_category"), as_money(F.col("cost")).alias("product_cost"),
    )
    fact = retail_sales(tables["orders"], tables["customers"], tables["products"])
    return extracted, build_marts(fact, tables["customers"], products, as_of, out_dir)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--raw")
    parser.add_argument("--out")
    parser.add_argument("--config")
    parser.add_argument("--as-of", type=dt.date.fromisoformat)
    args = parser.parse_args()
    if args.config:
        paths, folder, registry = read_config(args.config)
        extracted, built = run_etl(build_session(), "", args.out or folder, args.as_of, paths, registry)
    elif args.raw and args.out:
        extracted, built = run_etl(build_session(), args.raw, args.out, args.as_of)
    else:
        parser.error("give --config, or --raw and --out")
    extracted.show(truncate=False)
    if built is not None:
        built.show(truncate=False)


if __name__ == "__main__":
    main()
