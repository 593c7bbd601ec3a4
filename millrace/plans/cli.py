"""``python -m millrace.plans.cli ingest|clean|enrich``: the pipelines with exit codes 0, 1 and 2."""

from __future__ import annotations

import argparse
import logging
import sys

from millrace.plans import clean, enrich, ingest
from millrace.session import local_session, ship, stop
from millrace.sources.fetch import file_fetcher, http_fetcher

log = logging.getLogger("millrace")


def main(arguments: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {"ingest": ["address", "folder"], "clean": ["store", "folder"], "enrich": ["clean", "folder", "offers", "contrast", "mapping"]}.items():
        command = commands.add_parser(name)
        for o in options:
            command.add_argument(o)
        command.add_argument("--stop", action="store_true", help="stop the session at the end")
        command.add_argument("--files", action="store_true", help="addresses are local paths")
    a = parser.parse_args(arguments)
    fetch = file_fetcher() if a.files else http_fetcher()
    spark = local_session()
    ship(spark)
    if a.command == "ingest":
        result = ingest.run(spark, a.address, a.folder, fetch)
    elif a.command == "clean":
        result = clean.run(spark, a.store, a.folder)
    else:
        result = enrich.run(spark, a.clean, a.folder, a.offers, a.contrast, a.mapping, fetch)
    for name, value in vars(result).items():
        log.info("%s: %s %s", a.command, name, value)
    log.info("%s: %s", a.command, {0: "done", 1: "failed", 2: "done with differences or issues"}[result.code])
    if a.stop:
        stop(spark)
    return result.code


if __name__ == "__main__":
    sys.exit(main())
