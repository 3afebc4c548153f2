"""python -m seqsift.sources.restore DUMP FOLDER: a new collection of what a dump has."""

import os
import sys

from pyspark.sql import SparkSession

from seqsift.sources.collection import Collection


def main(dump: str, folder: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    made = Collection.restore(spark, os.path.abspath(dump) if "://" not in dump else dump, folder)
    print(f"{made.meta['tracks']} tracks in {folder}")


if __name__ == "__main__":
    main(*sys.argv[1:3])
