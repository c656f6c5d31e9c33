"""Command line: features, train, predict, briefing, and run, which makes features and predicts.

    python -m mediacast.cli run DATA MODEL OUTPUT.csv

``MEDIACAST_LOG`` sets the level of the log on standard error, ``MEDIACAST_SIMS`` the number of simulations.
Both may stand in a file ``.env`` of the working folder; what the environment has goes before it.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from dataclasses import replace

from pyspark.sql import SparkSession

from . import config
from .functions.stage import write_text
from .operators import model, prepare
from .plans import score as plans
from .sources import exports

log = logging.getLogger("mediacast")


def read_env(path: str = ".env") -> None:
    """Adds the ``NAME=value`` lines of a file to the environment where a name is not set; a file that cannot be read adds none."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except (OSError, UnicodeDecodeError):
        return
    for line in lines:
        name, given, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if given and name and not name.startswith("#"):
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            os.environ.setdefault(name, value[1:-1] if quoted else value)


def settings() -> config.Forecast:
    return replace(config.Forecast(), n_sims=int(os.environ.get("MEDIACAST_SIMS", config.N_SIMS)))


def features(spark: SparkSession, data: str, path: str) -> None:
    panel, quarantine = exports.load_checked(spark, data)
    prepare.prepare(panel).save(path)
    quarantine.write.mode("overwrite").parquet(f"{path}/quarantine")
    log.info("features in %s", path)


def train(spark: SparkSession, data: str, path: str) -> None:
    cfg = replace(settings(), n_sims=min(settings().n_sims, config.BACKTEST_SIMS))
    plans.train(prepare.prepare(exports.load(spark, data)), cfg).save(path)
    log.info("model in %s", path)


def predict(spark: SparkSession, path: str, trained: str, output: str) -> plans.Result:
    """The predictions as one CSV, and beside it forecast_summary.json with the headline; the latter can fail without harm."""
    p, cfg = prepare.Prepared.load(spark, path), settings()
    result = plans.score(p, model.Model.load(spark, trained), cfg)
    plans.write_predictions(result.predictions, output)
    try:
        _summarise(spark, p, result, cfg, output.rpartition("/")[0] or ".")
    except Exception as why:  # noqa: BLE001  the predictions stand without their summary
        log.warning("no forecast_summary.json: %s", why)
    return result


def _summarise(spark: SparkSession, p: prepare.Prepared, result: plans.Result, cfg: config.Forecast, folder: str) -> None:
    found = plans.headline(result.predictions)
    summary = {"forecast_origin": str(p.origins.first()["origin"]), "model_version": model.VERSION, "horizons": list(cfg.horizons), "headline": found}
    write_text(spark, f"{folder}/forecast_summary.json", json.dumps(summary, indent=2))
    for days, x in found.items():
        log.info("next %s: revenue of %.0f (%.0f to %.0f), return of %.2f", days, x["revenue_p50"], x["revenue_p10"], x["revenue_p90"], x["roas_p50"] or 0)


def briefing(spark: SparkSession, path: str, trained: str, output: str) -> str:
    p, cfg = prepare.Prepared.load(spark, path), settings()
    result = plans.score(p, model.Model.load(spark, trained), cfg)
    return plans.write_briefing(plans.facts(result, p, cfg), spark, output)


def run(spark: SparkSession, data: str, trained: str, output: str) -> None:
    features(spark, data, f"{output}.features")
    predict(spark, f"{output}.features", trained, output)


COMMANDS = {
    "features": (features, ("data", "path")), "train": (train, ("data", "path")), "predict": (predict, ("path", "model", "output")),
    "briefing": (briefing, ("path", "model", "output")), "run": (run, ("data", "model", "output")),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mediacast", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, names) in COMMANDS.items():
        command = commands.add_parser(name)
        for x in names:
            command.add_argument(x)
    args = parser.parse_args(argv)
    read_env()
    logging.basicConfig(level=os.environ.get("MEDIACAST_LOG", "INFO").upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("mediacast").getOrCreate()
    body, names = COMMANDS[args.command]
    body(spark, *[getattr(args, x) for x in names])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
