"""python -m quillon [-p EXPR | -e EXPR | FILE …]: evaluate expressions; without any, read them from the terminal."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .expr import to_text
from .reader import IncompleteInput, read_all, write
from .session import Session


def shown(x, raw: bool) -> str:
    return to_text(x) if raw else write(x)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("-p", "--print", action="append", default=[], metavar="EXPR", help="evaluate and print")
    p.add_argument("-e", "--evaluate", action="append", default=[], metavar="EXPR", help="evaluate")
    p.add_argument("--raw", action="store_true", help="print in the kernel's compact form")
    p.add_argument("--dialect", choices=("relational", "catalogue"))
    p.add_argument("files", nargs="*")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session = Session(spark, a.dialect)

    def run(text: str, show: bool) -> None:
        for x in read_all(text):
            out = session.call(x)
            if show:
                print(shown(out, a.raw), flush=True)

    for text in a.evaluate:
        run(text, False)
    for text in a.print:
        run(text, True)
    for f in a.files:
        with open(f, encoding="utf-8") as lines:
            run(lines.read(), True)
    if not (a.print or a.evaluate or a.files):
        text = ""
        for line in sys.stdin:
            text += line
            try:
                read_all(text)
            except IncompleteInput:
                continue
            run(text, True)
            text = ""
    return 0


if __name__ == "__main__":
    sys.exit(main())
