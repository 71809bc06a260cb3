"""Command line: ht (index), assem (contigs), sf (scaffolds), assem_sf, all."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomseq", description=__doc__)
    p.add_argument("mode", choices=["ht", "assem", "sf", "assem_sf", "all"])
    p.add_argument("-f", nargs="+", default=[], help="read files (FASTA or FASTQ)")
    p.add_argument("-p", type=int, default=0, choices=[0, 1, 2], help="0 single, 1 mates in two files, 2 mates in one file")
    p.add_argument("-k", type=int, default=25)
    p.add_argument("-r", type=int, default=0, help="cut reads to this length")
    p.add_argument("-q", type=int, default=2, help="least quality of a base")
    p.add_argument("-g", help="snapshot folder of an earlier ht")
    p.add_argument("-cf", nargs="+", help="contig files for sf")
    p.add_argument("-ins_len", type=float)
    p.add_argument("-ins_sdev", type=float)
    p.add_argument("-mf", help="placements of the reads on the contigs (match_info of assem); without them the reads are mapped")
    p.add_argument("-s", type=int, help="size of the regions at contig ends (2000)")
    p.add_argument("-gf", default="y", choices=["y", "yes", "n", "no"], help="fill gaps within scaffolds")
    p.add_argument("-o", default="", help="prefix of the output files")
    p.add_argument("-d", default=".", help="output folder, on any file system")
    p.add_argument("-m", type=int, help="least contig length")
    return p


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def main(argv: list[str] | None = None) -> dict:
    p = parser()
    a = p.parse_args(argv)
    if a.mode in ("ht", "all") and not a.f:
        p.error("read files are needed (-f)")
    if a.mode in ("assem", "assem_sf", "sf") and not a.g:
        p.error("a snapshot is needed (-g)")
    if a.p == 1 and len(a.f) % 2:
        p.error("-p 1 needs an even number of files")
    if (a.ins_len is None) != (a.ins_sdev is None) and a.ins_len is None:
        p.error("-ins_sdev needs -ins_len")
    spark = SparkSession.builder.appName("loomseq").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = a.g or a.d
    if a.mode == "sf" and not a.cf and not exists(spark, f"{a.g}/contigs"):
        p.error("contigs are needed (-cf)")
    name = f"{a.o}_" if a.o else ""
    got: dict = {}
    if a.mode in ("ht", "all"):
        got["params"] = pipeline.index(spark, a.f, out, a.p, a.k, a.r, single_qual=a.q)
    if a.mode in ("assem", "assem_sf", "all"):
        got["contigs"] = pipeline.report(pipeline.contigs(spark, out, a.m, f"{name}contigs"))
    if a.mode in ("sf", "assem_sf", "all"):
        got["scaffolds"] = pipeline.report(pipeline.scaffolds(spark, out, a.cf, a.ins_len, a.ins_sdev, a.gf[0] == "y", f"{name}scaffolds", a.mf, a.s))
    for k, v in got.items():
        print(k, v)
    return got


if __name__ == "__main__":
    main()
