"""One run from places to a submission: python -m quern.plans.cli --root FOLDER --model rf --params '{"rf": {"numTrees": 50}}'."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from quern.plans import housing
from quern.plans.runner import Runner, RunResult
from quern.sources.files import Places, project_root


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quern", description="Trains on the tables under a root and writes predictions and what is known of the run.")
    p.add_argument("--root", help="URI of the folder with data/raw and data/ext; by default the project's")
    p.add_argument("--model", default="ensemble", help="gbt, rf, linear, or ensemble")
    p.add_argument("--weights", type=json.loads, default=None, help='of an ensemble, as JSON: {"gbt": 0.5, "rf": 0.5}')
    p.add_argument("--params", type=json.loads, default={}, help="by model, as JSON")
    p.add_argument("--split", type=json.loads, default={"kind": "time_holdout"}, help="of validation rows, as JSON; null for none")
    p.add_argument("--out", help="folder of the run's own folder; by default the root's outputs/subs")
    p.add_argument("--prefix", default="submission")
    p.add_argument("--seed", type=int, default=42)
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> RunResult:
    a = arguments(argv)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    places = Places(a.root or str(project_root()))
    runner, out = Runner(housing.builder(spark, places), a.params), a.out or f"{places.outputs}/subs"
    if a.model == "ensemble":
        done = runner.run_ensemble(a.weights, a.split, out, a.prefix, a.seed)
    else:
        done = runner.run(a.model, a.split, out, a.prefix, a.seed)
    print(json.dumps({"run": done.run, "path": done.path, "valid_rmse": done.meta.get("valid_rmse")}))
    return done


if __name__ == "__main__":
    main()
