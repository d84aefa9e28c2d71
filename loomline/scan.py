"""One scan from targets to a report: ``python -m loomline.scan [flags] target ...``."""

from __future__ import annotations

import argparse
import sys
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from loomline import config
from loomline.operators import report
from loomline.sources.scan import codebase_files, parse_functions, read_patterns, source_files, with_lengths


class Progress:
    """Calls ``tell(done, total)`` about tasks of Spark's running stages after each ``every`` of them, and at the end."""

    def __init__(self, spark: SparkSession, tell: Callable[[int, int], None], every: int = 100, wait: float = 0.2) -> None:
        self.status, self.tell, self.every, self.wait = spark.sparkContext.statusTracker(), tell, every, wait
        self.stop, self.seen, self.told = threading.Event(), {}, 0

    def _look(self) -> tuple[int, int]:
        for stage in self.status.getActiveStageIds():
            info = self.status.getStageInfo(stage)
            if info:
                self.seen[stage] = (info.numCompletedTasks, info.numTasks)
        return sum(d for d, _ in self.seen.values()), sum(n for _, n in self.seen.values())

    def _run(self) -> None:
        while not self.stop.wait(self.wait):
            done, total = self._look()
            if done - self.told >= self.every:
                self.told = done
                self.tell(done, total)

    def __enter__(self) -> Progress:
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.stop.set()
        self.thread.join()
        total = sum(n for _, n in self.seen.values())
        self.tell(total, total)


def functions_of(spark: SparkSession, targets: Sequence[str], options: config.Options) -> DataFrame:
    """The functions of the targets, by the built-in rules, the options' patterns and the ignore file's."""
    patterns = [*options.ignore_patterns, *read_patterns(options.ignore_file)]
    return with_lengths(parse_functions(source_files(spark, targets, patterns), options.min_lines))


def codebase_functions(spark: SparkSession, target: str, more: Sequence[str] = ()) -> DataFrame:
    """The functions of a codebase without tests, generated and vendored files; files that cannot be read are left out."""
    return with_lengths(parse_functions(codebase_files(source_files(spark, [target]), more)))


def scan(spark: SparkSession, targets: Sequence[str], options: config.Options | None = None, output: str | None = None) -> dict:
    """The report of one scan, written to ``output`` (standard output if none) in the options' format."""
    options = (options or config.Options()).validate()
    document = report.report(functions_of(spark, targets, options), options)
    report.write(document, output, options.format)
    return document


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomline.scan")
    parser.add_argument("targets", nargs="+")
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--min-lines", type=int)
    parser.add_argument("--format")
    parser.add_argument("--workers", type=int)
    parser.add_argument("--output")
    parser.add_argument("--config")
    parser.add_argument("--ignore-file")
    parser.add_argument("--progress", action="store_true")
    flags = parser.parse_args(argv)
    try:
        options = config.load(flags.config).override(threshold=flags.threshold, min_lines=flags.min_lines, format=flags.format, workers=flags.workers, ignore_file=flags.ignore_file).validate()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if spark is None:
        from loomline.session import local_session

        spark = local_session(options.workers or "*")
    if flags.progress:
        with Progress(spark, lambda done, total: print(f"{done}/{total}", file=sys.stderr)):
            scan(spark, flags.targets, options, flags.output)
    else:
        scan(spark, flags.targets, options, flags.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
