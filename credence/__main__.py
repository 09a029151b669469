"""spark-submit entry point: ``python -m credence produce|sink|train|score`` (see --help)."""

from __future__ import annotations

import argparse
import json

from credence.plans import run
from credence.schema import TEST_SIZE
from credence.session import get_spark
from credence.sources.topic import TOPIC_ARTICLES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="credence", description="Article credibility on Spark")
    p.add_argument("--format", default="kafka", help="topic format: kafka, or parquet/json files below --topics")
    p.add_argument("--topics", help="folder of file-based topics")
    p.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="topic option, e.g. kafka.bootstrap.servers=...")
    jobs = p.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("produce", help="raw data sets to the article topic")
    a.add_argument("--raw", required=True)
    a.add_argument("--sources", default="kaggle,liar")
    a.add_argument("--limit", type=int, default=0, help="most records to send (0 = all)")
    a.add_argument("--topic", default=TOPIC_ARTICLES)
    a = jobs.add_parser("sink", help="article topic to date-partitioned JSON lines")
    a.add_argument("--root", required=True)
    a.add_argument("--checkpoint", required=True)
    a.add_argument("--topic", default=TOPIC_ARTICLES)
    a.add_argument("--rate", type=int, help="most offsets (or files) per micro-batch")
    a.add_argument("--exit-when-idle", action="store_true")
    a = jobs.add_parser("train", help="train, compare, publish the better classifier")
    a.add_argument("--root", help="landed articles")
    a.add_argument("--from-local", metavar="RAW", help="raw data sets instead of landed articles")
    a.add_argument("--registry", help="where to publish; without it nothing is published")
    a.add_argument("--test-size", type=float, default=TEST_SIZE)
    a = jobs.add_parser("score", help="score the incoming topic")
    a.add_argument("--registry", required=True, action="append", help="model folder; repeat for fallbacks")
    a.add_argument("--archive", required=True)
    a.add_argument("--checkpoint", required=True)
    a.add_argument("--exit-when-idle", action="store_true")
    a.add_argument("--wait-seconds", type=float, default=0, help="how long to wait for a first model")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_spark(f"credence-{args.job}")
    where = {"format": args.format, **dict(o.split("=", 1) for o in args.option)}
    if args.topics:
        where["path"] = args.topics
    if args.job == "produce":
        run.produce(spark, args.raw, [s.strip() for s in args.sources.split(",")], args.limit, args.topic, **where).show()
    elif args.job == "sink":
        run.sink(spark, args.root, args.checkpoint, args.exit_when_idle, args.rate, args.topic, **where).awaitTermination()
    elif args.job == "train":
        if args.from_local:
            _, document = run.train_from_raw(spark, args.from_local, args.registry, test_size=args.test_size)
        elif args.root:
            _, document = run.train_from_landed(spark, args.root, args.registry, test_size=args.test_size)
        else:
            raise SystemExit("train needs --root or --from-local")
        print(json.dumps(document, indent=2, ensure_ascii=False))
    else:
        run.score_incoming(spark, args.registry, args.archive, args.checkpoint, args.exit_when_idle,
                           wait_seconds=args.wait_seconds, **where).awaitTermination()


if __name__ == "__main__":
    main()
