"""Command line: python -m helixframe COMMAND ..., on the session that Spark's settings give.

    create PATH FILE...          a collection of FASTA files (options -k, -s, -l, --adaptive)
    add PATH FOLDER              the files of a folder that are not in yet, batch by batch
    listset PATH                 samples
    listctg PATH SAMPLE...       sample and contig lines
    getset PATH SAMPLE...        contigs of samples as FASTA (or --prefix)
    getctg PATH SAMPLE CONTIG    a contig, or with --range START-END a part of it
    length PATH SAMPLE CONTIG    its bases
    inspect PATH                 storage, or --groups, --layout, --group N, --pack GROUP PACK
    costs PATH SAMPLE CONTIG N   cost of every base of a segment against its reference
    import PATH FILE             a collection of what is in an archive
    export PATH FILE             an archive of a collection
    unpack FILE                  streams and parts of an archive

Results go to the standard output, or with -o to a file or folder.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .operators import grouping
from .plans import collection
from .sources import archive, container, fasta
from .streaming import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-o", "--output", help="where results go")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for a in arguments:
            c.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
        return c

    for c in (command("create", "path", "files+"), command("add", "path", "folder")):
        c.add_argument("-k", type=int, default=31)
        c.add_argument("-s", "--segment-size", type=int, default=60_000)
        c.add_argument("-l", "--min-match", type=int, default=20)
        c.add_argument("--adaptive", action="store_true")
    command("listset", "path").add_argument("--prefix", default="")
    command("listctg", "path", "samples+")
    c = command("getset", "path")
    c.add_argument("samples", nargs="*")
    c.add_argument("--prefix")
    command("getctg", "path", "sample", "contig").add_argument("--range")
    command("length", "path", "sample", "contig")
    c = command("inspect", "path")
    c.add_argument("--groups", action="store_true")
    c.add_argument("--layout", action="store_true")
    c.add_argument("--group", type=int)
    c.add_argument("--pack", type=int, nargs=2)
    command("costs", "path", "sample", "contig", "segment")
    command("import", "path", "file")
    command("export", "path", "file")
    command("unpack", "file")
    return p


def lines(df: DataFrame, *columns: str) -> Iterable[str]:
    """Rows as tab-separated lines, partition after partition."""
    for r in df.select(*[F.col(c).cast("string") for c in columns or df.columns]).toLocalIterator():
        yield "\t".join("" if x is None else x for x in r)


def records(df: DataFrame) -> Iterable[str]:
    return lines(fasta.fasta_text(df.orderBy("sample", "contig"), F.concat_ws("#", "sample", F.col("contig").cast("string")), F.col("seq")))


def run(spark: SparkSession, args: argparse.Namespace) -> Iterable[str]:
    if args.command == "create":
        contigs = fasta.contigs(spark, args.files, by_file=True)
        collection.create(contigs, args.path, args.k, args.segment_size, args.min_match, args.adaptive)
        return []
    if args.command == "add":
        stream = ingest.contig_stream(spark, args.folder)
        ingest.ingest_collection(stream, args.path, f"{args.path}/_checkpoint", k=args.k, segment_size=args.segment_size, min_match=args.min_match).awaitTermination()
        ingest.finalize(spark, args.path)
        return []
    if args.command == "unpack":
        return lines(container.parts(spark, args.file).orderBy("stream_id", "part_id"), "stream", "part_id", "offset", "size")
    if args.command == "import":
        a = archive.Archive(spark, args.file)
        collection.create(a.contigs(), args.path, a.params["k"], a.params["segment_size"], a.params["min_match_len"])
        return []
    c = collection.Collection(spark, args.path)
    if args.command == "export":
        archive.export(c, args.file)
        return []
    if args.command == "listset":
        return lines(c.samples(args.prefix), "sample")
    if args.command == "listctg":
        return (f"{s}\t{x}" for s in args.samples for x in lines(c.contigs(s).orderBy("contig"), "contig"))
    if args.command == "getset":
        return records(c.by_prefix(args.prefix) if args.prefix is not None else c.sample(*args.samples))
    if args.command == "length":
        return [str(c.length(args.sample, args.contig))]
    if args.command == "getctg":
        if not args.range:
            return records(c.rebuilt(c._known(c.segments(args.sample, args.contig), f"contig: {args.sample} {args.contig}")))
        start, end = (int(x) for x in args.range.split("-"))
        seq = c.range(args.sample, args.contig, start, end)
        return [f">{args.sample}:{args.contig} {args.contig}:{start}-{end}", *(seq[i : i + fasta.LINE] for i in range(0, len(seq), fasta.LINE))]
    if args.command == "costs":
        row = c.sequences(c.segments(args.sample, args.contig).filter(F.col("part") == int(args.segment))).first()
        if row is None:
            raise KeyError(f"no such segment: {args.sample} {args.contig} {args.segment}")
        if row["group_id"] < grouping.FIRST_GROUP:
            return ["no reference: the segment has no k-mers"]
        ref, seq = (codec.to_codes(x) for x in (c.reference(row["group_id"]), row["seq"]))
        if row["is_rev_comp"]:
            seq = codec.turned(seq)
        differ = codec.Differ(ref, c.min_match)
        return [f"estimate\t{differ.estimate(seq)}", *(f"{i}\t{a}\t{b}" for i, (a, b) in enumerate(zip(differ.costs(seq, True).tolist(), differ.costs(seq, False).tolist(), strict=True)))]
    if args.pack:
        return [repr(x)[2:-1] for x in c.part(*args.pack).split(collection.END)[:-1]]
    if args.group is not None:
        return lines(c.segments(group=args.group).orderBy("sample", "contig", "part"))
    if args.groups:
        return lines(c.group_statistics())
    return lines(c.segments().orderBy("sample", "contig", "part")) if args.layout else lines(c.storage_statistics())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out = run(spark or SparkSession.builder.appName("helixframe").getOrCreate(), args)
        if args.output:
            with Path(args.output).open("w") as file:
                file.writelines(f"{x}\n" for x in out)
        else:
            for x in out:
                print(x)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
