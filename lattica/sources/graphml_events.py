"""GraphML documents read in one scan, in parallel, with their nesting.

Spark's text source deals out the files in blocks, cut behind each ``>``.  A task takes every block for one that begins
outside of comments, CDATA sections and tags, and keeps a stack of what is open in it.  What is closed
in its own block is a whole record; what isn't leaves a fragment, and each block tells in which state it
ended.  The driver goes over blocks and fragments in order, no more of them than blocks times
the depth of nesting: a block that did begin within a comment or the like is read again from that
state, and elements that lie over the end of a block are put together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.plans.storage import Scratch
from lattica.sources.endpoints import decoded

#: Elements that become records, and those that an import can't express.
RECORDS, UNSUPPORTED = ("node", "edge", "key"), ("hyperedge", "port")
#: What a block may begin in: the text between tags, or something that hides tags (with what has been read of it).
TEXT = "text"
_ENDS = {"comment": "--", "cdata": "]]", "pi": "?"}
_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_QUOTED = re.compile(r"""("[^"]*"|'[^']*')""")
_REFERENCE = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|amp|lt|gt|quot|apos);")
# Entities that XML itself has.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

_DATA = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("data", _DATA)])
_DDL = "file string, block long, n long, kind string, attributes map<string,string>, data array<struct<key: string, value: string>>"


class MalformedXmlError(ValueError):
    pass


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        return _NAMED[name] if name[0] != "#" else chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))

    return _REFERENCE.sub(one, text) if "&" in text else text


@dataclass
class _Open:
    """An element that isn't closed yet; n: its place in its block."""

    tag: str
    n: int
    attributes: dict[str, str] = field(default_factory=dict)
    data: dict[str, str] = field(default_factory=dict)
    text: list[str] = field(default_factory=list)


class Reader:
    """Events of one block.  Rows are (n, kind, attributes, data).

    Kinds: node, edge, key: whole records; "unsupported": what the policy is about; "graph": one whose surroundings begin
    before the block; "open", "close", "data" and "text": fragments; "end": the state behind the last piece.
    """

    def __init__(self, state: tuple[str, str] = (TEXT, "")):
        self.mode, self.held = state
        self.stack: list[_Open] = []
        self.rows: list[tuple] = []
        self.n, self.loose, self.graphs = 0, [], -1
        self.closes = 0

    def row(self, kind: str, attributes: dict[str, str], data: dict[str, str] | None = None, n: int | None = None) -> None:
        self.rows.append((self.n if n is None else n, kind, attributes, list((data or {}).items())))

    def feed(self, piece: str) -> None:
        """What stands before the next ``>``."""
        self.n += 1
        if self.mode in _ENDS:
            if self.mode == "cdata":
                self._text(piece + ">" if not piece.endswith("]]") else piece[:-2])
            if piece.endswith(_ENDS[self.mode]):
                self.mode, self.held = TEXT, ""
            return
        if self.mode == TEXT:
            text, bracket, tag = piece.partition("<")
            self._text(unescaped(text) if bracket else unescaped(piece) + ">")
            if not bracket:
                return
        else:
            tag = self.held + ">" + piece
        if tag.startswith("!--"):
            self.mode, self.held = (TEXT, "") if tag.endswith("--") and len(tag) >= 5 else ("comment", "")
        elif tag.startswith("![CDATA["):
            done = tag.endswith("]]")
            self._text(tag[8:-2] if done else tag[8:] + ">")
            self.mode, self.held = (TEXT, "") if done else ("cdata", "")
        elif tag.startswith("?"):
            self.mode, self.held = (TEXT, "") if tag.endswith("?") else ("pi", "")
        else:
            bare = _QUOTED.sub("", tag)
            if '"' in bare or "'" in bare or tag.startswith("!") and "[" in bare and not bare.rstrip().endswith("]"):
                self.mode, self.held = "tag", tag
                return
            self.mode, self.held = TEXT, ""
            if tag.startswith("/"):
                self._close(tag[1:].strip().rpartition(":")[2])
            elif not tag.startswith("!"):
                self._open(tag)

    def _text(self, text: str) -> None:
        if self.stack:
            if self.stack[-1].tag == "data":
                self.stack[-1].text.append(text)
        else:
            self.loose.append(text)

    def _open(self, tag: str) -> None:
        alone = tag.endswith("/")
        head = re.match(r"[^\s/]*", tag)[0]
        name = head.rpartition(":")[2]
        attributes = {k: unescaped(re.sub(r"[\t\r\n]", " ", a or b)) for k, a, b in _ATTRIBUTE.findall(tag[len(head) :])}
        self.loose = []
        if name in UNSUPPORTED or name == "graph" and any(o.tag in ("graph", "node", "edge") for o in self.stack):
            self.row("unsupported", {"tag": name})
        elif name == "graph" and not self.stack and self.graphs < self.closes:
            self.graphs = self.closes
            self.row("graph", {})
        self.stack.append(_Open(name, self.n, attributes))
        if alone:
            self._close(name)

    def _close(self, name: str) -> None:
        if not self.stack:
            self.row("close", {"tag": name, "text": "".join(self.loose)})
            self.loose = []
            self.closes += 1
            return
        own = self.stack.pop()
        if own.tag != name:
            raise MalformedXmlError(f"</{name}> closes <{own.tag}>")
        self.finish(own)

    def finish(self, own: _Open) -> None:
        if own.tag == "data":
            key, value = own.attributes.get("key"), "".join(own.text).replace("\r\n", "\n")
            if key is None:
                return
            if self.stack:
                self.stack[-1].data.pop(key, None)
                self.stack[-1].data[key] = value
            else:
                self.row("data", {"key": key, "value": value})
        elif own.tag in RECORDS:
            self.row(own.tag, own.attributes, own.data, own.n)

    def end(self) -> None:
        """Fragments of what is still open, and the state."""
        if self.loose and "".join(self.loose).strip():
            self.row("text", {"text": "".join(self.loose)})
        for own in self.stack:
            self.row("open", {f"@{k}": v for k, v in own.attributes.items()} | {"tag": own.tag, "text": "".join(own.text), "n": str(own.n)}, own.data)
        self.row("end", {"mode": self.mode, "held": self.held})


def _read(states: dict[tuple[str, int], tuple[str, str]]):
    def run(batches):
        at, reader, out = None, None, []

        def rows(own: Reader) -> list[tuple]:
            got, own.rows = own.rows, []
            return [(*at, n, kind, list(attributes.items()), [{"key": k, "value": v} for k, v in data]) for n, kind, attributes, data in got]

        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file"), batch.column("block").to_pylist()
            ends = (files[0].as_py(), blocks[0]), (files[len(files) - 1].as_py(), blocks[-1])
            places = None if ends[0] == ends[1] else list(zip(files.to_pylist(), blocks))
            for i, piece in enumerate(batch.column("value").to_pylist()):
                here = ends[0] if places is None else places[i]
                if here != at:
                    if reader is not None:
                        reader.end()
                        out += rows(reader)
                    at, reader = here, Reader(states.get(here, (TEXT, "")))
                reader.feed(piece or "")
            out += rows(reader)
            if out:
                yield batch_of(out)
                out = []
        if reader is not None:
            reader.end()
            yield batch_of(rows(reader))

    return run


def read_events(spark: SparkSession, path: str, charset: str, keep: Scratch) -> DataFrame:
    """(file, block, n, kind, attributes, data) of all nodes, edges, keys and unsupported elements below ``path``."""
    pieces = spark.read.option("lineSep", ">").text(path).select(decoded(F.col("value"), charset).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parsed = keep.stored(pieces.mapInArrow(_read({}), _DDL), "events")
    states: dict[tuple[str, int], tuple[str, str]] = {}
    whole = F.col("kind").isin(*RECORDS, "unsupported")
    while True:
        fragments = parsed.where(~whole).orderBy("file", "block", "n").collect()
        wrong = _wrong_starts(fragments, states)
        if not wrong:
            break
        states |= wrong
        again = F.concat_ws("\n", "file", "block").isin(*[f"{f}\n{b}" for f, b in wrong])
        parsed = keep.stored(parsed.where(~again).union(pieces.where(again).mapInArrow(_read(wrong), _DDL)), "events")
    made = _put_together(fragments)
    out = parsed.where(whole)
    return out.union(spark.createDataFrame(made, _DDL)) if made else out


def _blocks(fragments: list):
    """(file, [(block, its fragments)]) in order."""
    files: dict[str, dict[int, list]] = {}
    for r in fragments:
        files.setdefault(r["file"], {}).setdefault(r["block"], []).append(r)
    return [(f, sorted(blocks.items())) for f, blocks in files.items()]


def _wrong_starts(fragments: list, states: dict) -> dict[tuple[str, int], tuple[str, str]]:
    """Blocks that were read from another state than the one in which the block before them ends."""
    out = {}
    for file, blocks in _blocks(fragments):
        state = (TEXT, "")
        for block, rows in blocks:
            if states.get((file, block), (TEXT, "")) != state:
                out[file, block] = state
            end = next(r["attributes"] for r in rows if r["kind"] == "end")
            state = (end["mode"], end["held"])
    return out


def _put_together(fragments: list) -> list[tuple]:
    """Records of elements that lie over several blocks."""
    made = []
    for file, blocks in _blocks(fragments):
        stack: list[tuple[int, _Open]] = []
        state = (TEXT, "")
        for block, rows in blocks:
            for r in rows:
                a = r["attributes"]
                top = stack[-1][1] if stack else None
                if r["kind"] == "open":
                    own = _Open(a["tag"], int(a["n"]), {k[1:]: v for k, v in a.items() if k.startswith("@")}, {d["key"]: d["value"] for d in r["data"]}, [a["text"]])
                    stack.append((block, own))
                elif r["kind"] == "graph":
                    if any(o.tag in ("graph", "node", "edge") for _, o in stack):
                        made.append((file, block, r["n"], "unsupported", {"tag": "graph"}, []))
                elif r["kind"] == "data" and top is not None:
                    top.data.pop(a["key"], None)
                    top.data[a["key"]] = a["value"]
                elif r["kind"] == "text" and top is not None:
                    top.text.append(a["text"])
                elif r["kind"] == "close":
                    if top is None or top.tag != a["tag"]:
                        raise MalformedXmlError(f"{file}: </{a['tag']}> closes {top and f'<{top.tag}>' or 'nothing'}")
                    top.text.append(a["text"])
                    at, own = stack.pop()
                    one = Reader()
                    one.stack = [o for _, o in stack]
                    one.finish(own)
                    made += [(file, at, n, kind, attributes, [dict(zip(("key", "value"), d)) for d in data]) for n, kind, attributes, data in one.rows if kind in RECORDS]
                elif r["kind"] == "end":
                    state = (a["mode"], a["held"])
        if stack or state[0] != TEXT:
            raise MalformedXmlError(f"{file}: the document ends within {stack and f'<{stack[-1][1].tag}>' or state[0]}")
    return made
