"""Facts of word-processor packages: zipped XML, read in tasks from binary files."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder

#: Namespaces and the stories of parts by their names; fixed values.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELATIONS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
STORIES = {"document": "body", "header": "header", "footer": "footer", "footnotes": "footnote", "endnotes": "endnote", "comments": "comment"}
#: seq: number in its story (paragraphs), paragraph (runs), row (cells) or part. parent: the paragraph of runs and objects. style: style, tag of a control, kind of an object, id of a relationship.
FACTS = "path string, kind string, part string, story string, seq long, parent long, text string, style string, alias string, section long, start long, stop long, table_index long, row long, cell long, block boolean, target string, external boolean"
KINDS = ("paragraph", "run", "control", "cell", "object", "relationship", "part", "error")
#: Parts that every package has; fixed values.
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
COLUMNS = [x.split()[0] for x in FACTS.split(", ")]


def text_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{WORD}t"))


def value_of(node: ElementTree.Element, path: str) -> str | None:
    found = node.find("/".join(WORD + x for x in path.split("/")))
    return None if found is None else found.get(f"{WORD}val")


class Part:
    """One part of a package: where each of its nodes lies."""

    def __init__(self, root: ElementTree.Element):
        self.root = root
        self.parent = {child: node for node in root.iter() for child in node}
        self.table = {t: k for k, t in enumerate(root.iter(f"{WORD}tbl"))}

    def above(self, node: ElementTree.Element) -> Iterator[ElementTree.Element]:
        while (node := self.parent.get(node)) is not None:
            yield node

    def place(self, node: ElementTree.Element) -> dict:
        """Table, row and cell of the nearest table around a node."""
        cell = next((x for x in self.above(node) if x.tag == f"{WORD}tc"), None)
        if cell is None:
            return {}
        row = self.parent[cell]
        table = self.parent[row]
        if row.tag != f"{WORD}tr" or table.tag != f"{WORD}tbl":
            return {}
        return {"table_index": self.table[table], "row": [*table.findall(f"{WORD}tr")].index(row), "cell": [*row.findall(f"{WORD}tc")].index(cell)}

    def facts(self, story: str) -> Iterator[dict]:
        """Paragraphs, runs, objects and controls in order; what lies in text boxes is a story of its own with its own numbers."""
        numbers, section, number_of = Counter(), 0, {}
        for p in self.root.iter(f"{WORD}p"):
            own = "textbox" if any(x.tag == f"{WORD}txbxContent" for x in self.above(p)) else story
            numbers[own] += 1
            number_of[p] = own, numbers[own], section
            common = {"story": own, "section": section, **self.place(p)}
            at, runs = 0, []
            for k, run in enumerate(r for r in p.iter(f"{WORD}r") if self.paragraph(r) is p):
                text = "".join(t.text or "" for t in run.iter(f"{WORD}t") if self.paragraph(t) is p)
                runs.append({"kind": "run", "seq": k + 1, "parent": numbers[own], "text": text, "style": value_of(run, "rPr/rStyle"), "start": at, "stop": at + len(text), **common})
                at += len(text)
            yield {"kind": "paragraph", "seq": numbers[own], "text": "".join(r["text"] for r in runs), "style": value_of(p, "pPr/pStyle"), "start": 0, "stop": at, **common}
            yield from runs
            found = [("image", "", x.get(f"{OFFICE}embed")) for x in p.iter(f"{DRAWING}blip")] + [("formula", "".join(t.text or "" for t in x.iter(f"{MATH}t")), None) for x in p.iter(f"{MATH}oMath")]
            found += [("field", x.get(f"{WORD}instr"), None) for x in p.iter(f"{WORD}fldSimple")] + [("field", x.text, None) for x in p.iter(f"{WORD}instrText")]
            for k, (kind, text, target) in enumerate(found):
                yield {"kind": "object", "seq": k + 1, "parent": numbers[own], "style": kind, "text": text, "target": target, **common}
            if p.find(f"{WORD}pPr/{WORD}sectPr") is not None:
                section += 1
        for control in self.root.iter(f"{WORD}sdt"):
            around = self.paragraph(control)
            first = around if around is not None else next(control.iter(f"{WORD}p"), None)
            own, number, its_section = number_of.get(first, (story, None, None))
            content = control.find(f"{WORD}sdtContent")
            text = text_of(control if content is None else content)
            start = 0 if around is None else len("".join(t.text or "" for t in self.before(around, control)))
            yield {"kind": "control", "story": own, "seq": number, "section": its_section, "text": text, "style": value_of(control, "sdtPr/tag"), "alias": value_of(control, "sdtPr/alias"), "block": around is None, "start": start, "stop": start + len(text), **(self.place(first) if first is not None else {})}
        for table, k in self.table.items():
            for r, row in enumerate(table.findall(f"{WORD}tr")):
                for c, cell in enumerate(row.findall(f"{WORD}tc")):
                    yield {"kind": "cell", "story": story, "seq": c + 1, "text": text_of(cell), "table_index": k, "row": r, "cell": c}

    def paragraph(self, node: ElementTree.Element) -> ElementTree.Element | None:
        return next((x for x in self.above(node) if x.tag == f"{WORD}p"), None)

    def before(self, around: ElementTree.Element, node: ElementTree.Element) -> Iterator[ElementTree.Element]:
        """Texts of a paragraph before a node in it."""
        for x in around.iter():
            if x is node:
                return
            if x.tag == f"{WORD}t":
                yield x


def facts_of(content: bytes) -> Iterator[dict]:
    """Rows of FACTS without the path. A broken package, a broken part and a part that can't be unpacked are error rows; the other parts stay."""
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        names = sorted(set(package.namelist()))
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        yield {"kind": "error", "text": "package_invalid"}
        return
    for part in names:
        yield {"kind": "part", "part": part}
        try:
            content = package.read(part)
            if not part.endswith((".xml", ".rels")):
                continue
            root = ElementTree.fromstring(content)
        except ElementTree.ParseError:
            yield {"kind": "error", "part": part, "text": "xml_invalid"}
            continue
        except (zipfile.BadZipFile, RuntimeError, OSError, EOFError, ValueError, NotImplementedError, zlib.error):
            yield {"kind": "error", "part": part, "text": "part_unreadable"}
            continue
        if part.endswith(".rels"):
            for k, node in enumerate(root.iter(f"{RELATIONS}Relationship")):
                yield {"kind": "relationship", "part": part, "seq": k + 1, "text": node.get("Type"), "style": node.get("Id"), "target": node.get("Target"), "external": node.get("TargetMode") == "External"}
        elif (name := re.fullmatch(r"word/([a-z]+)\d*\.xml", part)) and name[1] in STORIES:
            for fact in Part(root).facts(STORIES[name[1]]):
                yield {"part": part, **fact}


def ingest_docx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a folder of packages by kind of fact, from one reading: bytes stay in the tasks that parse them.

    The facts are written to the shared folder once, a folder for each kind, so a table reads its own kind alone. Broken
    files and parts give error rows.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {x.split()[0]: "Int64" for x in FACTS.split(", ") if x.endswith(" long")} | {"block": "boolean", "external": "boolean"}
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                facts = [{**fact, "path": file} for fact in facts_of(bytes(content))]
                yield pd.DataFrame({c: pd.Series([f.get(c) for f in facts], dtype=kinds.get(c, object)) for c in COLUMNS})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    store = f"{shared_folder(spark).rstrip('/')}/stratadoc-{uuid.uuid4().hex}"
    facts = files.mapInPandas(parse, FACTS)
    facts.write.partitionBy("kind").parquet(store)
    stored = spark.read.schema(facts.schema).parquet(store)
    return {kind: stored.where(F.col("kind") == kind).select(COLUMNS) for kind in KINDS}


def target_part(part: Column, target: Column) -> Column:
    """The part that a relationship of a .rels part names, from the folder of its owner; dots are resolved."""
    base = F.regexp_replace(part, r"(^|/)_rels/[^/]*$", "")
    steps = F.filter(F.split(F.when(target.startswith("/"), target).otherwise(F.concat(base, F.lit("/"), target)), "/"), lambda x: (x != "") & (x != "."))
    up = lambda at: F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda at, x: F.when(x == "..", up(at)).otherwise(F.concat(at, F.array(x)))), "/")


def check_packages(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, code, part) of what is wrong with packages: unreadable ones and parts, required parts that aren't there, relationships without a target or to parts that aren't there; external ones are passed over."""
    codes = F.create_map(*[F.lit(x) for x in ("package_invalid", "invalid_docx_package", "xml_invalid", "invalid_package_xml", "part_unreadable", "corrupt_zip_member")])
    parts = tables["part"].select("path", "part").distinct()
    wrong = tables["error"].select("path", codes[F.col("text")].alias("code"), "part")
    needed = parts.select("path").distinct().select("path", F.explode(F.array(*[F.lit(x) for x in REQUIRED])).alias("part"))
    wrong = wrong.unionByName(needed.join(parts, ["path", "part"], "left_anti").select("path", F.lit("missing_package_parts").alias("code"), "part"))
    inner = tables["relationship"].where("not external")
    wrong = wrong.unionByName(inner.where("coalesce(target, '') = ''").select("path", F.lit("relationship_without_target").alias("code"), "part"))
    named = inner.where("target <> ''").select("path", target_part(F.col("part"), F.col("target")).alias("part"))
    return wrong.unionByName(named.join(parts, ["path", "part"], "left_anti").select("path", F.lit("dangling_relationship").alias("code"), "part").distinct())
