"""python -m colloom pack FOLDER ARCHIVE | list ARCHIVE | get ARCHIVE NAME | unpack ARCHIVE FOLDER | verify ARCHIVE FOLDER"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import archive


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="colloom", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, names in (("pack", ("folder", "archive")), ("list", ("archive",)), ("get", ("archive", "name")), ("unpack", ("archive", "folder")), ("verify", ("archive", "folder"))):
        s = sub.add_parser(verb)
        for n in names:
            s.add_argument(n)
        if verb == "pack":
            s.add_argument("--batch", type=int, default=256, help="files in a batch at most")
            s.add_argument("--max-mb", type=int, default=64, help="megabytes in a batch at most")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("colloom").getOrCreate()
    if a.verb == "pack":
        archive.pack(spark, a.folder, a.archive, a.batch, a.max_mb << 20)
    elif a.verb == "list":
        for r in archive.list_files(spark, a.archive).orderBy("name").toLocalIterator():
            print(r["n_bytes"], r["name"])
    elif a.verb == "get":
        sys.stdout.buffer.write(archive.get(spark, a.archive, a.name))
    elif a.verb == "unpack":
        print(archive.write_files(archive.unpack(spark, a.archive), a.folder), "files")
    else:
        bad = archive.verify(spark, a.archive, a.folder).filter("state != 'same'")
        for r in bad.toLocalIterator():
            print(r["state"], r["name"])
        return int(not bad.isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
