"""Text formats of interaction data. Lines that don't fit a format are skipped."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.functions.domain import pdockq
from unpaired.functions.numeric import rounded
from unpaired.graph import Graph, canonical
from unpaired.tables import settle

# Structural proteins that a bait table writes with one letter.
STRUCTURAL = ("E", "M", "N", "S")
# Fixed value: atoms nearer than this are in contact (Angstrom).
CONTACT = 8.0
#: Rows of a record batch that a reader of packed files gives.
BATCH = 4096


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``file`` and ``at``, their order: later lines of a file have greater ``at``."""
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * 2**20 + F.monotonically_increasing_id() % 2**33).alias("at"))


def _last(df: DataFrame, *key: str) -> DataFrame:
    """The last line of each key wins."""
    order = W.Window.partitionBy(*key).orderBy(F.desc("file"), F.desc("at"))
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "file", "at")


def _parts(value: str = "value", pattern: str = "\\s+") -> Column:
    return F.split(F.trim(value), pattern)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Two ids a line, blanks between; self-pairs and short lines go: distinct (u, v)."""
    p = _parts()
    return canonical(lines(spark, path).where(F.size(p) >= 2).select(p[0].alias("u"), p[1].alias("v")))


def pair_list(spark: SparkSession, path: str, restrict_to: DataFrame | None = None) -> DataFrame:
    """As :func:`edge_list` without ``#`` comments, both ends among ``restrict_to`` (id)."""
    p = _parts()
    rows = lines(spark, path).where(~F.ltrim("value").startswith("#") & (F.size(p) >= 2))
    pairs = canonical(rows.select(p[0].alias("u"), p[1].alias("v")).where("u <> '' and v <> ''"))
    return pairs if restrict_to is None else within(pairs, restrict_to)


def within(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with both ends among ``nodes`` (id)."""
    own = nodes.select("id").distinct()
    return pairs.join(own.withColumnRenamed("id", "u"), "u", "left_semi").join(own.withColumnRenamed("id", "v"), "v", "left_semi").select(*pairs.columns)


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """Header, then ``id<TAB>id1,id2``: (src, dst), one row for each target."""
    table = spark.read.csv(path, sep="\t", header=True)
    a, b = table.columns[:2]
    return exploded_map(table.select(F.col(a).alias("src"), F.col(b).alias("targets")))


def exploded_map(table: DataFrame) -> DataFrame:
    targets = F.filter(F.transform(F.split("targets", ","), lambda x: F.trim(x)), lambda x: x != "")
    return table.select("src", F.explode(targets).alias("dst")).distinct()


def map_pairs(pairs: DataFrame, mapping: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Pairs carried through an m:n map at both ends: distinct, no self-pairs, within ``nodes``."""
    a = mapping.select(F.col("src").alias("u"), F.col("dst").alias("x"))
    b = mapping.select(F.col("src").alias("v"), F.col("dst").alias("y"))
    out = canonical(pairs.select("u", "v").join(a, "u").join(b, "v").select(F.col("x").alias("u"), F.col("y").alias("v")))
    return out if nodes is None else within(out, nodes)


def clean_set(text: Column) -> Column:
    """Comma-separated members, trimmed, lower-cased, distinct, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def localization(spark: SparkSession, path: str) -> DataFrame:
    """``node<TAB>c1,c2``: (node, compartments); the last line of a node wins, empty sets go."""
    p = F.split("value", "\t")
    rows = lines(spark, path).where(F.size(p) >= 2).select(F.trim(p[0]).alias("node"), clean_set(p[1]).alias("compartments"), "file", "at")
    return _last(rows.where(F.size("compartments") > 0), "node")


def scalar(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``node value``: (node, field); lines without a number go, the last line wins."""
    p = _parts()
    rows = lines(spark, path).where(F.size(p) >= 2).select(p[0].alias("node"), p[1].try_cast("double").alias(field), "file", "at")
    return _last(rows.where(F.col(field).isNotNull()), "node")


def pair_values(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``a<TAB>b<TAB>value``: (lo, hi, field, value); unordered, the last line wins."""
    p = F.split("value", "\t")
    rows = lines(spark, path).where(F.size(p) >= 3).select(F.least(F.trim(p[0]), F.trim(p[1])).alias("lo"), F.greatest(F.trim(p[0]), F.trim(p[1])).alias("hi"), F.lit(field).alias("field"), F.trim(p[2]).try_cast("double").alias("number"), "file", "at")
    return _last(rows.where("number is not null"), "lo", "hi").withColumnRenamed("number", "value")


def annotation_table(parts: list[DataFrame]) -> DataFrame | None:
    """Full outer merge of per-node tables by ``node``; a missing value is null."""
    out = None
    for part in parts:
        out = part if out is None else out.join(part, "node", "full_outer")
    return out


def pair_table(parts: list[DataFrame]) -> DataFrame | None:
    """Union of (lo, hi, field, value) tables."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def embeddings(spark: SparkSession, path: str, key: str = "id", vector: str = "vec") -> DataFrame:
    """(id, vec) from Parquet; ids become strings."""
    return spark.read.parquet(path).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vec"))


def positive_sources(spark: SparkSession, manifest: str, restrict_to: DataFrame | None = None, modality: str | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Union of a manifest's sources: pairs (u, v, source), counts by source, missing names.

    Disabled sources are left out. Manifest and sources are read through Spark, so they may lie
    on any file system it knows; paths are relative to the manifest's folder.
    """
    import yaml

    manifest = str(manifest)
    text = spark.read.text(manifest, wholetext=True).collect()  # a short file
    folder = manifest.rsplit("/", 1)[0] + "/" if "/" in manifest else ""
    out, missing = None, []
    for entry in yaml.safe_load(text[0][0] if text else "") or []:
        if not entry.get("enabled", True) or (modality and entry.get("modality", modality) != modality):
            continue
        path = entry["path"] if entry["path"].startswith("/") or "://" in entry["path"] else folder + entry["path"]
        try:
            part = pair_list(spark, path, restrict_to).withColumn("source", F.lit(entry["name"]))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(entry["name"])
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "u string, v string, source string")
    return out, source_report(out), missing


def source_report(pairs: DataFrame) -> DataFrame:
    """Pairs by source, and in the union: (source, n)."""
    union = pairs.select("u", "v").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("union").alias("source"), "n")
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).union(union)


def certified(report: DataFrame) -> DataFrame:
    """Whether any source gave pairs: a run without known positives isn't certified."""
    return report.where("source <> 'union'").agg(F.coalesce(F.max(F.col("n") > 0), F.lit(False)).alias("certified"))


def host_pathogen_graph(table: DataFrame, include_host_host: bool = True) -> Graph:
    """A bait-prey table (Bait, PreyUniprotAcc, PreyGeneName) as a viral-host graph.

    Baits are viral by name; a host bait is carried to its accession by the table's own
    gene names (the greatest accession of a name). Host-host edges stay in the graph.
    """
    own = table.where("Bait is not null and PreyUniprotAcc is not null").select(F.trim("Bait").alias("bait"), F.trim("PreyUniprotAcc").alias("prey"), F.trim("PreyGeneName").alias("gene"))
    viral = F.lower("bait").rlike("^(nsp|orf)") | F.col("bait").isin(*STRUCTURAL)
    names = own.where("gene is not null").groupBy("gene").agg(F.max("prey").alias("_acc"))
    mapped = own.withColumn("viral", viral).join(names.withColumnRenamed("gene", "bait"), "bait", "left")
    edges = mapped.select(F.when(F.col("viral"), F.col("bait")).otherwise(F.coalesce("_acc", "bait")).alias("u"), F.col("prey").alias("v"), "viral")
    edges = edges if include_host_host else edges.where("viral")
    ends = edges.select(F.col("u").alias("id"), F.col("viral")).union(edges.select("v", F.lit(False)))
    nodes = ends.groupBy("id").agg(F.max("viral").alias("viral")).select("id", F.when(F.col("viral"), "viral").otherwise("host").alias("type"))
    return Graph.from_edges(edges, nodes, [("host", "viral")], "host_pathogen")


def alias_map(aliases: DataFrame, ids: DataFrame, accession_source: str = "UniProt_AC", gene_prefix: str = "ENSG", gene_source: str = "Ensembl") -> DataFrame:
    """(id, target): the first alias row of each wanted id, of the source its id space asks for.

    ``aliases`` has ``target, alias, source, at``.
    """
    gate = F.when(F.col("alias").startswith(gene_prefix), F.col("source").startswith(gene_source)).otherwise(F.col("source") == accession_source)
    own = aliases.where(gate).join(ids.select(F.col("id").alias("alias")).distinct(), "alias", "left_semi")
    return own.groupBy("alias").agg(F.min_by("target", "at").alias("target")).select(F.col("alias").alias("id"), "target")


def channel_scores(spark: SparkSession, path: str, channel: str, pairs: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(lo, hi, value) of one channel of a links file (blank-separated, header, thousandths).

    Only pairs asked for, or within ``nodes`` (id); of several rows of a pair the largest value counts.
    """
    table = spark.read.csv(path, sep=" ", header=True)
    own = table.select(F.least("protein1", "protein2").alias("lo"), F.greatest("protein1", "protein2").alias("hi"), (F.col(channel).try_cast("double") / 1000).alias("value"))
    if pairs is not None:
        own = own.join(pairs.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), ["lo", "hi"], "left_semi")
    if nodes is not None:
        own = within(own.withColumnsRenamed({"lo": "u", "hi": "v"}), nodes).withColumnsRenamed({"u": "lo", "v": "hi"})
    return own.where("value is not null").groupBy("lo", "hi").agg(F.max("value").alias("value"))


def mapped_channel_scores(spark: SparkSession, path: str, channel: str, aliases: DataFrame, pairs: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(lo, hi, value) of one channel, asked and answered in the caller's ids.

    Ids are mapped to those of the links file (:func:`alias_map`), the file is scanned for
    the mapped pairs or nodes, and scores are mapped back to every pair asked for. A pair
    without a mapping or a row is left out.
    """
    asked = nodes if nodes is not None else pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    to = settle(alias_map(aliases, asked.select("id").distinct()), "alias-map")
    a, b = (to.select(F.col("id").alias(end), F.col("target").alias(f"_{end}")) for end in ("u", "v"))
    if nodes is not None:
        found = channel_scores(spark, path, channel, nodes=to.select(F.col("target").alias("id")).distinct())
        own = found.join(a, F.col("lo") == F.col("_u")).join(b, F.col("hi") == F.col("_v"))
    else:
        own = pairs.select("u", "v").distinct().join(a, "u").join(b, "v")
        found = channel_scores(spark, path, channel, pairs=own.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
        own = own.join(found, (F.least("_u", "_v") == F.col("lo")) & (F.greatest("_u", "_v") == F.col("hi")))
    ends = own.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "value")
    return ends.groupBy("lo", "hi").agg(F.max("value").alias("value"))


def known_links(spark: SparkSession, path: str, aliases: DataFrame, channel: str = "experimental", above: float = 0.9, source: str = "UniProt_AC") -> DataFrame:
    """(u, v): pairs whose channel is above a bound, in the ids of one alias source; the first alias of an id wins."""
    strong = channel_scores(spark, path, channel).where(F.col("value") > above)
    named = aliases.where(F.col("source") == source).groupBy("target").agg(F.min_by("alias", "at").alias("alias"))
    a, b = (named.select(F.col("target").alias(end), F.col("alias").alias(new)) for end, new in (("lo", "u"), ("hi", "v")))
    return canonical(strong.join(a, "lo").join(b, "hi").select("u", "v"))


def biogrid(spark: SparkSession, path: str, taxon: str = "9606") -> DataFrame:
    """Physical interactions within one taxon, from a tab file with named columns: (u, v)."""
    t = spark.read.csv(path, sep="\t", header=True)
    clean = lambda c: F.regexp_extract(F.col(c), "^([A-Z0-9]{6,10})", 1)
    own = t.where((F.lower("Experimental System Type") == "physical") & (F.col("Organism ID Interactor A") == taxon) & (F.col("Organism ID Interactor B") == taxon))
    return canonical(own.select(clean("SWISS-PROT Accessions Interactor A").alias("u"), clean("SWISS-PROT Accessions Interactor B").alias("v")).where("u <> '' and v <> ''"))


def mitab(spark: SparkSession, path: str, taxon: str = "9606") -> DataFrame:
    """Interactions of UniProt ids within one taxon, from a PSI-MITAB file: (u, v)."""
    p = F.split("value", "\t")
    own = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(p) >= 11))
    prefix = "uniprotkb:"
    keep = p[0].startswith(prefix) & p[1].startswith(prefix) & p[9].contains(taxon) & p[10].contains(taxon)
    accession = lambda i: F.substring_index(F.substring_index(p[i], ":", -1), "-", 1)
    return canonical(own.where(keep).select(accession(0).alias("u"), accession(1).alias("v")))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Header, then ``A_B<TAB>positive|negative``: (u, v, y)."""
    table = spark.read.csv(path, sep="\t", header=True)
    name, label = table.columns[:2]
    p = F.split(F.col(name), "_", 2)
    return table.where(F.size(p) == 2).select(p[0].alias("u"), p[1].alias("v"), (F.lower(F.trim(label)) == "positive").cast("int").alias("y"))


def complexes(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``Name`` (``A-B``) and ``pDockQ``: (u, v, pdockq), names of two parts and numbers only."""
    table = spark.read.csv(path, header=True)
    p = F.split("Name", "-")
    return table.where(F.size(p) == 2).select(p[0].alias("u"), p[1].alias("v"), F.col("pDockQ").try_cast("double").alias("pdockq")).where("pdockq is not null")


def display_names(genes: DataFrame) -> DataFrame:
    """(id, name): ``symbol — full (aka a, b)`` from (id, symbol, full, aliases array)."""
    aka = F.when(F.size("aliases") > 0, F.concat(F.lit(" (aka "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    return genes.select("id", F.concat(F.concat_ws(" — ", "symbol", "full"), aka).alias("name"))


def embeddings_npz(spark: SparkSession, path: str, ids: str = "ids", vectors: str = "emb") -> DataFrame:
    """(id, vec) from npz files with the arrays ``ids`` and ``emb``; ids become strings.

    Spark reads and deals out the files, each of 2 GB at most; rows are given in batches.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as packed:
                    names, table = packed[ids], packed[vectors]
                for i in range(0, len(names), BATCH):
                    rows = table[i : i + BATCH].astype(np.float64)
                    ends = np.arange(len(rows) + 1, dtype=np.int32) * table.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in names[i : i + BATCH].tolist()]), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))], ["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "id string, vec array<double>")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_rows(content: bytes, sheet: str) -> Iterator[dict[int, str]]:
    """The rows of one sheet of a workbook: text by column number. Cells are read one row at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = [x.get(_LINK) for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet") if x.get("name") == sheet]
        if not found:
            raise ValueError(f"no sheet {sheet!r}")
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{_SHEET}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        target = links[found[0]]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as table:
            for _, row in ElementTree.iterparse(table):
                if row.tag != f"{_SHEET}row":
                    continue
                cells, at = {}, -1
                for cell in row.iter(f"{_SHEET}c"):
                    letters = (cell.get("r") or "").rstrip("0123456789")
                    at = at + 1 if not letters else sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1
                    value = cell.find(f"{_SHEET}v")
                    if cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield cells
                row.clear()


def spreadsheet(spark: SparkSession, path: str, sheet: str, columns: list[str]) -> DataFrame:
    """The named ``columns`` of one sheet of xlsx files as text; the first row is the header, empty cells are null.

    Spark reads and deals out the files; a file is one task's.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = _sheet_rows(content.as_py(), sheet)
                header = {text.strip(): i for i, text in next(rows, {}).items()}
                if missing := [c for c in columns if c not in header]:
                    raise ValueError(f"sheet {sheet!r} has no column {missing[0]!r}")
                kept: list[list[str | None]] = []
                for row in rows:
                    if row:
                        kept.append([row.get(header[c]) for c in columns])
                    if len(kept) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*kept, strict=True)], columns)
                        kept = []
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*kept, strict=True)], columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, ", ".join(f"`{c}` string" for c in columns))


def pocket_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(node, pocket_volume, pocket_hydrophobicity, pocket_polarity) of ``<node>_info.txt`` files.

    A file has a block of lines for each pocket, blank lines between; the first is the
    largest one and alone counts. Below its title a line is a name, a colon and a number.
    A file without any such line gives no row; a share of polar atoms is given in percent.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*)_info\\.txt$", 1).alias("node"), "value")
    blocks = F.filter(F.split("value", "\n\n"), lambda b: F.trim(F.regexp_replace(b, "\\s", " ")) != "")
    first = F.split(F.get(blocks, F.lit(0)), "\r?\n")
    # a block may begin with a line break that was left of the blank lines before it
    entries = F.slice(F.filter(first, lambda x: F.trim(x) != ""), 2, 1_000)
    named = F.filter(F.transform(entries, lambda x: F.struct(F.regexp_extract(x, r"^\s*(.*?)\s*:[^:]*$", 1).alias("name"), F.regexp_extract(x, r":\s*([^:\s]*)\s*$", 1).try_cast("double").alias("number"))), lambda x: (x["name"] != "") & x["number"].isNotNull())
    one = lambda name: F.try_element_at(F.transform(F.filter("fields", lambda x: x["name"] == name), lambda x: x["number"]), F.lit(-1))
    own = text.select("node", named.alias("fields")).where(F.size("fields") > 0)
    out = own.select("node", rounded(one("Volume")).alias("pocket_volume"), rounded(one("Hydrophobicity score")).alias("pocket_hydrophobicity"), rounded(one("Proportion of polar atoms") / 100).alias("pocket_polarity"))
    return out.where("pocket_volume is not null or pocket_hydrophobicity is not null or pocket_polarity is not null")


def residues(spark: SparkSession, path: str) -> DataFrame:
    """(file, chain, residue, x, y, z, plddt, at) from PDB files: the beta carbon of each residue (alpha of glycine).

    Of several records of one residue the last counts. ``at`` is the place of the chain in its file.
    """
    f = lambda start, size: F.trim(F.substring("value", start, size))
    own = lines(spark, path).where(F.substring("value", 1, 4) == "ATOM").where(f(13, 4) == F.when(f(18, 3) == "GLY", "CA").otherwise("CB"))
    own = own.select("file", "at", F.substring("value", 22, 1).alias("chain"), f(23, 4).cast("int").alias("residue"), *[f(s, 8).cast("double").alias(c) for c, s in (("x", 31), ("y", 39), ("z", 47))], f(61, 6).cast("double").alias("plddt"))
    begins = own.groupBy("file", "chain").agg(F.min("at").alias("begins"))
    latest = W.Window.partitionBy("file", "chain", "residue").orderBy(F.desc("at"))
    last = own.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "at")
    return last.join(begins, ["file", "chain"]).withColumnRenamed("begins", "at")


def interface_contacts(atoms: DataFrame, threshold: float = CONTACT) -> DataFrame:
    """(file, a, b, contacts, plddt, pdockq) of every two chains of a file, ``a`` the one that begins first.

    Contacts are pairs of residues nearer than ``threshold``. Residues lie in cells of a grid of
    that width, and each meets only those of its own and the 26 cells around. ``plddt`` is the
    mean over the residues in contact, of both chains; two chains without contacts score 0.
    """
    cell = lambda c: F.floor(F.col(c) / threshold).cast("int")
    placed = settle(atoms.select("*", *[cell(c).alias(f"c{c}") for c in "xyz"]), "residues")
    chains = placed.select("file", "chain", "at").distinct()
    a, b = (chains.select("file", F.col("chain").alias(n), F.col("at").alias(f"_{n}")) for n in "ab")
    both = a.join(b, "file").where("_a < _b").select("file", "a", "b")
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    side = lambda n: placed.select("file", F.col("chain").alias(n), F.col("residue").alias(f"r{n}"), F.col("plddt").alias(f"p{n}"), F.col("at").alias(f"at{n}"), *[F.col(c).alias(f"{c}{n}") for c in "xyz"], "cx", "cy", "cz")
    reached = side("b")
    for c in "xyz":
        reached = reached.withColumn("_d", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
    apart = sum(((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in "xyz"), F.lit(0.0))
    met = settle(side("a").join(reached, ["file", "cx", "cy", "cz"]).where((F.col("ata") < F.col("atb")) & (apart < threshold**2)).select("file", "a", "b", "ra", "rb", "pa", "pb"), "contacts")
    counted = met.groupBy("file", "a", "b").agg(F.count(F.lit(1)).alias("contacts"))
    touched = met.select("file", "a", "b", F.lit("a").alias("s"), F.col("ra").alias("r"), F.col("pa").alias("p")).unionByName(met.select("file", "a", "b", F.lit("b").alias("s"), F.col("rb").alias("r"), F.col("pb").alias("p"))).distinct()
    confidence = touched.groupBy("file", "a", "b").agg(F.avg("p").alias("plddt"))
    own = both.join(counted, ["file", "a", "b"], "left").join(confidence, ["file", "a", "b"], "left").na.fill(0, ["contacts"])
    return own.select("file", "a", "b", "contacts", "plddt", F.when(F.col("contacts") > 0, rounded(pdockq(F.col("plddt"), F.col("contacts")))).otherwise(0.0).alias("pdockq"))
