"""Command line: python -m kinmesh.cli train|predict|full|blocking|validate ..."""

from __future__ import annotations

import argparse
import sys

from kinmesh.config import Config, checkpoint_root
from kinmesh.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinmesh")
    sub = p.add_subparsers(dest="mode", required=True)
    for mode in ("train", "predict", "full"):
        s = sub.add_parser(mode)
        s.add_argument("--train-dir")
        s.add_argument("--test-dir")
        s.add_argument("--model", required=True)
        s.add_argument("--out")
        s.add_argument("--sample-size", type=int)
        s.add_argument("--no-resume", action="store_true")
        s.add_argument("--clear-checkpoints", action="store_true")
        s.add_argument("--clear-cache", action="store_true")
        s.add_argument("--parts", action="store_true", help="write results in parts, by many tasks, instead of one file each")
        s.add_argument("--generation", type=int, choices=(0, 1, 2), default=2, help="2: current; 1: first, single file; 0: first, modules")
    s = sub.add_parser("blocking")
    s.add_argument("--train-dir", required=True)
    s.add_argument("--country", required=True)
    s.add_argument("--n-queries", type=int, default=2000)
    s.add_argument("--pool-fraction", type=float, default=0.05)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--out")
    s = sub.add_parser("validate")
    s.add_argument("--matching", required=True)
    s.add_argument("--candidate")
    s.add_argument("--test-dir", required=True)
    s.add_argument("--check-ids", action="store_true")
    return p


def _paths(folder: str, prefix: str) -> dict[str, str]:
    return {"s1": f"{folder}/{prefix}_source1.tsv", "s2": f"{folder}/{prefix}_source2.tsv", "s3": f"{folder}/{prefix}_source3.tsv", "truth": f"{folder}/{prefix}_ground_truth.tsv"}


def main(argv: list[str] | None = None) -> int:
    from kinmesh.operators import validate as v
    from kinmesh.operators.features import FEATURE_NAMES
    from kinmesh.plans import first_generation, linkage
    from kinmesh.sources import readers, writers

    args = parser().parse_args(argv)
    spark, config = session(), Config()
    if args.mode == "validate":
        test = _paths(args.test_dir, "test")
        known = readers.union_pool(readers.read_ids(spark, test["s2"]), readers.read_ids(spark, test["s3"])) if args.check_ids else None
        found = v.validate(spark, args.matching, args.candidate, readers.read_ids(spark, test["s1"]), known).cache()
        for r in v.messages(found).orderBy("severity", "rule").collect():
            print(f"{r['severity'].upper()} {r['rule']}: {r['n']}, such as {', '.join(r['examples'])}")
        return int(not found.filter("severity = 'error'").isEmpty())
    if args.mode == "blocking":
        report, unique, curve = linkage.evaluate_blocking(spark, _paths(args.train_dir, "train"), args.country, Config(seed=args.seed), n_queries=args.n_queries, pool_fraction=args.pool_fraction)
        report = report.cache()
        for name, df in (("strategies", report), ("unique recall", unique), ("pre-filter caps", curve)):
            print(f"{name}\n{writers.text_table(df)}\n", file=sys.stderr)
        text = writers.json_report({"strategies": report, "unique_recall": unique, "prefilter_caps": curve}, vars(args))
        print(text)
        if args.out:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(args.out)
        return 0
    root = checkpoint_root()
    if args.clear_cache:
        print(f"{writers.clear_all(spark, root, 'cache')} caches deleted")
    if args.clear_checkpoints:
        print(f"{writers.clear_all(spark, root, 'train') + writers.clear_all(spark, root, 'predict')} runs deleted")
    old, kind = args.generation < 2, {} if args.generation == 2 else {"generation": args.generation}
    names = first_generation.NAMES[args.generation] if old else FEATURE_NAMES
    if args.mode in ("train", "full"):
        files = _paths(args.train_dir, "train")
        stages = writers.Stages(spark, root, "train", config, resume=not args.no_resume, sources=writers.identity(spark, *files.values()), sample=args.sample_size, **kind)
        s1, pool, truth = linkage.load_training(spark, _paths(args.train_dir, "train"), config, args.sample_size, generation=args.generation)
        trained = first_generation.run_train(s1, pool, truth, args.generation, config, stages) if old else linkage.run_train(s1, pool, truth, config, stages)
        writers.save_model(spark, trained.models, trained.threshold, names, args.model)
        print(f"threshold {trained.threshold}, held-out macro F0.5 {trained.score}")
        if old:
            print(", ".join(f"{k} {v}" for k, v in trained.report.items()))
    if args.mode in ("predict", "full"):
        models, threshold = readers.load_model(spark, args.model, names)
        test = _paths(args.test_dir, "test")
        # By content, not by path: a model trained anew in the same place must not meet the scores of the old one.
        stages = writers.Stages(spark, root, "predict", config, resume=not args.no_resume, sources=writers.identity(spark, *test.values()), model=writers.identity(spark, args.model), **kind)
        how = {"transliterate": config.transliterate, "generation": args.generation}
        s1, pool = readers.load_source(spark, test["s1"], **how), readers.union_pool(*readers.load_sources(spark, test["s2"], test["s3"], **how))
        matches, pairs = first_generation.run_predict(s1, pool, models, threshold, args.generation, stages) if old else linkage.run_predict(s1, pool, models, threshold, config, stages)
        linkage.write_run(s1, matches, pairs, args.out, single_file=not args.parts)
    return 0


if __name__ == "__main__":
    sys.exit(main())
