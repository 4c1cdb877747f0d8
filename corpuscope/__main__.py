"""python -m corpuscope: features, compare, search, status and bench from the command line."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _spark() -> SparkSession:
    from corpuscope.session import ship

    spark = SparkSession.builder.appName("corpuscope").getOrCreate()
    ship(spark)
    return spark


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="corpuscope")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("features", "compare", "query", "bench"):
        p = verbs.add_parser(name)
        p.add_argument("tables", help="folder of the input tables")
        p.add_argument("--out", help="folder for the result as CSV")
        if name in ("query", "bench"):
            p.add_argument("name", help="registered query")
    p = verbs.add_parser("search")
    p.add_argument("tables")
    p.add_argument("folder")
    for flag, kind, default in (("--source", str, "fr"), ("--target", str, "en"), ("--proposals", int, 10), ("--candidates", int, 16), ("--seed", int, 42), ("--documents", int, 50)):
        p.add_argument(flag, type=kind, default=default)
    p.add_argument("--no-form-reward", action="store_true")
    p.add_argument("--preset", choices=("v2", "v3", "v4", "v5"), default="v3", help="which operators and rewards take part")
    p.add_argument("--block", type=int, default=100, help="proposals of a block")
    p.add_argument("--stop-at", type=float, nargs=3, metavar=("STRUCT", "FORM", "FAMILY"), help="targets that end the run when all are met")
    p = verbs.add_parser("validate", help="scores every state of a search anew")
    p.add_argument("tables")
    p.add_argument("folder")
    p.add_argument("--target", default="en")
    verbs.add_parser("status").add_argument("folder")
    own = parser.parse_args(args)
    spark = _spark()
    if own.verb == "status":
        from corpuscope.operators.search import load_records

        records = load_records(spark, own.folder)
        print(json.dumps({"proposals": len(records), "accepted": sum(r["accepted"] for r in records), "state": records[-1]["state"] if records else None}))
        return 0
    if own.verb == "search":
        from corpuscope.operators.corpus import sequences
        from corpuscope.operators.lm import uniform_null
        from corpuscope.operators.search import Bank, BlockConfig, SearchConfig, run_blocks
        from corpuscope.plans.queries import corpora

        every = corpora(spark, own.tables)
        source = sequences(every.filter((F.col("corpus") == own.source) & (F.col("doc_id") < own.documents)))
        config = SearchConfig.preset(own.preset, seed=own.seed, proposals=own.proposals, candidates=own.candidates, form_reward=not own.no_form_reward)
        stops = BlockConfig(block=own.block, targets=tuple(own.stop_at) if own.stop_at else None)
        blocks = run_blocks(spark, source, every.filter(F.col("corpus") == own.target), config, own.folder, stops, Bank(every, uniform_null(spark)), requested_seed=own.seed)
        print(json.dumps(blocks[-1]))
        return 0
    if own.verb == "validate":
        from corpuscope.operators.lm import uniform_null
        from corpuscope.operators.search import Bank, audit
        from corpuscope.plans.queries import corpora

        every = corpora(spark, own.tables)
        bad = audit(spark, every.filter(F.col("corpus") == own.target), own.folder, bank=Bank(every, uniform_null(spark)))
        print(json.dumps({"differing": bad}))
        return 1 if bad else 0
    from corpuscope.catalog import QUERIES

    name = {"features": "feature_vector", "compare": "form_cosine"}.get(own.verb) or own.name
    began = time.time()
    result = QUERIES[name](spark, own.tables)
    if own.out:
        from corpuscope.sources.sinks import write_csv

        write_csv(result, own.out)
    elif own.verb == "bench":
        result.write.format("noop").mode("overwrite").save()
        print(json.dumps({name: round(time.time() - began, 3)}))
    else:
        result.show(200, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
