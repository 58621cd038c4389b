"""python -m stratafold list | run QUERY SF_DIR [OUT] | synthetic DATASET [K_MAX] | realdata DATASET PATH [K_MAX] | version

`synthetic` and `realdata` print the card of a dataset (simulated or from a file) and its segments."""

from __future__ import annotations

import sys

VERSION = "0.1.0"


def main(args: list[str]) -> int:
    if args[:1] == ["version"]:
        print(VERSION)
        return 0
    from .plans.queries import QUERIES

    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[:1] == ["run"] and len(args) in (3, 4) and args[1] in QUERIES:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("stratafold").getOrCreate()
        out = QUERIES[args[1]](spark, args[2])
        out.write.mode("overwrite").parquet(args[3]) if len(args) == 4 else out.show(50, False)
        return 0
    from .sources import files

    path = args[2:3] if args[:1] == ["realdata"] else []
    k_max = args[2 + len(path) :]
    if args[:1] in (["synthetic"], ["realdata"]) and len(args) > 1 + (args[0] == "realdata") and args[1] in files.CARDS and len(k_max) < 2 and all(k.isdigit() for k in k_max):
        show_segments(args[1], *path, k_max=int(k_max[0]) if k_max else 12)
        return 0
    print(__doc__)
    return 2


def show_segments(dataset: str, path: str | None = None, k_max: int = 12) -> None:
    import json

    from pyspark.sql import SparkSession

    from .operators import segment
    from .sources import files, sequences

    seq, card = files.load(SparkSession.builder.appName("stratafold").getOrCreate(), dataset, path)
    fit = segment.segment(sequences.complete(seq), card["family"], k_max, curves=False)
    print(json.dumps(card, sort_keys=True))
    fit.segment.orderBy("seq_id", "q").show(1000, False)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
