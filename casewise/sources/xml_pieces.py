"""XML documents read in pieces: one large file is cut into its elements by many tasks.

The text source splits a file at ``>``, so every split starts right after one: in plain content, or inside a comment, a CDATA section,
an instruction, or a quoted attribute. For each of these six starts a first pass notes what the split does: how many open elements it
closes, which it opens and leaves open (their start tags as written), and what is unfinished at its end. Such notes compose, so a
walk over the notes of a file, one row per split, gives what is open at the start of every split. A second pass gives a stream parser
the start tags that are open and then the split itself, so names, namespaces, entities and errors are those of the whole document.

Elements within one split are complete at once. Of an element that crosses splits each split gives its last text per child
name, and the texts are put together by (file, element, name): an element with very many children is no large row anywhere before
its own event is made.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.skew import broadcast_if_small
from casewise.sources.files import split_runs

END = ">"
# What may be unfinished where a split starts. A tag is named by a sign that no document can hold, as its beginning is not known yet.
UNKNOWN = b"<\x00"
STARTS = [b"", b"<!--", b"<![CDATA[", b"<?x ", UNKNOWN + b' a="', UNKNOWN + b" a='"]
_TAG = rb"[^\"'<>]*+(?:\"[^\"<]*+\"[^\"'<>]*+|'[^'<]*+'[^\"'<>]*+)*+"
TOKEN = re.compile(
    rb"(?P<aside><!--.*?-->|<\?.*?\?>)|(?P<text><!\[CDATA\[.*?\]\]>)|(?P<close></[^<>]*>)|(?P<open><[^!?/<>\s]" + _TAG + rb">)"
    rb"|(?P<type><!DOCTYPE[^\[<>\"']*(?:\"[^\"]*\"[^\[<>\"']*|'[^']*'[^\[<>\"']*)*(?:\[(?:<!--.*?-->|<\?.*?\?>|\"[^\"]*\"|'[^']*'|[^\]\"'])*+\]\s*)?>)",
    re.S,
)
OPEN_END = re.compile(rb"<[^!?/<>\s]" + _TAG + rb"(?:\"[^\"<]*|'[^'<]*)\Z", re.S)
ENCODING = re.compile(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._-]*)")
# Splits whose start is broadcast; more are joined.
BROADCAST_SPLITS = 200_000
# Rows and bytes that leave a task at a time: a batch for every small file would cost more than reading it.
BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20
# A file up to this size that is one split has no notes, since nothing starts in its middle; the parser checks it to its end.
SMALL = 1 << 20

_OPENED = pa.struct([("raw", pa.binary()), ("number", pa.int64()), ("text", pa.binary()), ("done", pa.bool_())])
_NOTE = pa.struct([
    ("pops", pa.int64()), ("lead", pa.binary()), ("touched", pa.bool_()), ("opened", pa.list_(_OPENED)), ("pending", pa.binary()),
    ("prolog", pa.binary()), ("fault", pa.string()),
])
SPLITS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("head", pa.binary()), ("bytes", pa.int64()), ("size", pa.int64()), ("notes", pa.list_(_NOTE))])
_OPENED_TYPE = "array<struct<raw: binary, number: bigint, text: binary, done: boolean>>"
SPLITS_TYPE = f"path string, block long, head binary, bytes long, size long, notes array<struct<pops: bigint, lead: binary, touched: boolean, opened: {_OPENED_TYPE}, pending: binary, prolog: binary, fault: string>>"
STATES = pa.schema([("of_path", pa.string()), ("of_block", pa.int64()), ("replay", pa.binary()), ("known", pa.list_(pa.int64())), ("done", pa.bool_()), ("ended", pa.bool_()), ("fault", pa.string()), ("alone", pa.bool_())])
STATES_TYPE = "of_path string, of_block long, replay binary, known array<bigint>, done boolean, ended boolean, fault string, alone boolean"
PACKED = "case_id long, evidence_id long, path string, block long, part long, text binary"
FOUND = "case_id long, evidence_id long, path string, seq long, tag string, record string, block long, name string, text string, kind string"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a split in one batch as one row, every piece with its end sign again."""
    part = 0
    for batch in batches:
        out = []
        for path, block, start, data in split_runs(batch, END):
            part += 1
            out.append((batch.column("case_id")[start].as_py(), batch.column("evidence_id")[start].as_py(), path, block, part, data))
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            names = ["case_id", "evidence_id", "path", "block", "part", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


class Note:
    """What the bytes so far do to the open elements, for one start of the split."""

    def __init__(self, start: bytes):
        self.pops, self.lead, self.touched = 0, [], False
        self.opened: list[list] = []  # start tag, number, texts before the first child, whether there is a child
        self.pending, self.prolog, self.fault, self.number = start, b"", None, 0

    def text(self, data: bytes) -> None:
        if self.opened:
            if not self.opened[-1][3]:
                self.opened[-1][2].append(data)
        elif not self.pops and not self.touched:
            self.lead.append(data)

    def child(self) -> None:
        if self.opened:
            self.opened[-1][3] = True
        elif not self.pops:
            self.touched = True

    def take(self, data: bytes) -> None:
        data, at = self.pending + data, 0
        self.pending = b""
        while at < len(data):
            found = data.find(b"<", at)
            if found < 0 or found > at:
                self.text(data[at : found if found > 0 else len(data)])
            if found < 0:
                return
            token = TOKEN.match(data, found)
            if not token:
                self.unfinished(data[found:])
                return
            at, kind = token.end(), token.lastgroup
            if kind == "text":
                self.text(token[0])
            elif kind == "close":
                if self.opened:
                    self.opened.pop()
                else:
                    self.pops += 1
            elif kind == "type":
                self.prolog = token[0]
            elif kind == "open":
                self.child()
                if not token[0].endswith(b"/>"):
                    self.opened.append([token[0], self.number, [], False])
                self.number += 1

    def unfinished(self, rest: bytes) -> None:
        if rest.startswith(b"<![CDATA["):
            # The section is cut in two, which leaves the text as it is.
            self.text(rest + b"]]>")
            self.pending = b"<![CDATA["
        elif rest.startswith((b"<!--", b"<?")):
            self.pending = b"<!--" if rest.startswith(b"<!--") else b"<?x "
        elif rest.startswith(b"<!DOCTYPE"):
            self.pending, self.fault = rest, "whole"
        elif OPEN_END.match(rest):
            self.pending = rest
        else:
            self.fault = "bad"

    def held(self) -> int:
        """About the bytes of its row."""
        return sum(map(len, self.lead)) + len(self.pending) + sum(len(raw) + sum(map(len, text)) for raw, _, text, _ in self.opened)

    def row(self) -> dict:
        opened = [{"raw": raw, "number": number, "text": b"".join(text), "done": done} for raw, number, text, done in self.opened]
        return {
            "pops": self.pops, "lead": b"".join(self.lead), "touched": self.touched, "opened": opened, "pending": self.pending, "prolog": self.prolog, "fault": self.fault,
        }


def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split, with a note for each start; those of small files leave together, without notes. A start that cannot be true ends at its first fault."""
    now, rows, held = None, [], 0

    def take(data: bytes) -> None:
        for note in notes:
            # A type declaration may go on in the next batch, but not in the next split.
            if note.fault == "whole":
                note.fault = None
            if note.fault is None:
                note.take(data)

    def add() -> None:
        nonlocal held
        if waiting and read >= size:
            notes.clear()
        for data in waiting:
            take(data)
        rows.append({"path": now[0], "block": now[1], "head": head, "bytes": read, "size": size, "notes": [n.row() for n in notes]})
        held += sum(n.held() for n in notes)

    def made() -> pa.RecordBatch:
        nonlocal held
        batch = pa.RecordBatch.from_pylist(rows, SPLITS)
        rows.clear()
        held = 0
        return batch

    for batch in batches:
        for path, block, start, data in split_runs(batch, END):
            if (path, block) != now:
                if now:
                    add()
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield made()
                now, size, read, waiting = (path, block), batch.column("size")[start].as_py(), 0, []
                # A file begins in plain content.
                head, notes = data[:1000], [Note(s) for s in (STARTS if block else STARTS[:1])]
            read += len(data)
            if block == 0 and size <= SMALL:
                waiting.append(data)
            else:
                take(data)
    if now:
        add()
        yield made()


def _start_of(pending: bytes) -> int:
    """Which of the starts an unfinished token is; a tag is told by the quote that is open."""
    if pending in STARTS:
        return STARTS.index(pending)
    bare = re.sub(rb"\"[^\"]*\"|'[^']*'", b"", pending)
    return 4 if b'"' in bare and (b"'" not in bare or bare.index(b'"') < bare.index(b"'")) else 5


def states_of(table: pa.Table) -> pa.Table:
    """What is open at the start of every split of one file, as text that brings a parser to this state, and the faults of the file."""
    return pa.Table.from_pylist(_walk(sorted(table.to_pylist(), key=lambda r: r["block"])), STATES)


def single_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for files that are one split each."""
    for batch in batches:
        yield pa.RecordBatch.from_pylist([state for split in batch.to_pylist() for state in _walk([split])], STATES)


def states(splits: DataFrame) -> DataFrame:
    """The states of all splits. Only files of several splits are grouped; a first split that has all bytes of its file is the only one."""
    single = (F.col("block") == 0) & (F.col("bytes") >= F.col("size"))
    several = splits.where(~single).groupBy("path").applyInArrow(states_of, STATES_TYPE)
    return splits.where(single).mapInArrow(single_states, STATES_TYPE).unionByName(several)


def _walk(splits: list[dict]) -> list[dict]:
    path, first, size = splits[0]["path"], splits[0], splits[0]["size"]
    ended = size - sum(s["bytes"] for s in splits) in (0, 3)  # a byte order mark is not read
    named = ENCODING.match(first["head"])
    begin = b'<?xml version="1.0" encoding="%s"?>' % named[1] if named else b""
    fault = "whole" if first["head"][:2] in (b"\xff\xfe", b"\xfe\xff") or b"\x00" in first["head"] else None
    if not first["notes"]:
        return [dict(zip(STATES.names, (path, first["block"], b"", [], False, ended, fault, True), strict=True))]
    stack: list[list] = []
    pending, prolog, rooted, out = b"", b"", False, []
    for split in splits:
        if split is not first:
            # After the root nothing but comments may follow; a root that is closed makes the parser refuse more.
            above = b"".join(raw + text for raw, _, text, _ in stack) or (b"<x/>" if rooted else b"")
            out.append((split["block"], begin + prolog + above + pending, [seq for _, seq, _, _ in stack], bool(stack) and stack[-1][3]))
        else:
            out.append((split["block"], b"", [], False))
        note = split["notes"][_start_of(pending)]
        fault = fault or note["fault"]
        if fault or note["pops"] > len(stack):
            fault = fault or "bad"
            break

        def whole(raw: bytes) -> bytes:
            return pending + raw[len(UNKNOWN) + 4 :] if raw.startswith(UNKNOWN) else raw

        prolog = prolog or note["prolog"]
        if note["pops"]:
            del stack[len(stack) - note["pops"] :]
        elif stack and not stack[-1][3]:
            stack[-1][2] += note["lead"]
            stack[-1][3] = note["touched"]
        rooted = rooted or note["touched"] or bool(stack)
        stack += [[whole(o["raw"]), split["block"] + o["number"], o["text"], o["done"]] for o in note["opened"]]
        pending = whole(note["pending"])
    if not fault and (stack or pending or not rooted):
        fault = "bad"
    if fault:
        out = [(first["block"], b"", [], False)]
    return [dict(zip(STATES.names, (path, *state, ended, fault, False), strict=True)) for state in out]


def short_name(tag: str) -> str:
    return tag.split("}")[-1]


class Elements:
    """Parser target that makes an element's row at its end.

    Not flat: every element that has children with text. Flat: the children of the root, with their own children under short
    lower-case names.
    """

    def __init__(self, flat: bool, block: int, known: list[int]):
        self.flat, self.block, self.known, self.seen = flat, block, known, 0
        self.stack: list[list] = []  # seq, tag, texts before the first child, whether there is a child, texts by child name, known before
        self.rows: list[tuple] = []

    def start(self, tag: str, attributes: dict) -> None:
        if self.stack:
            self.stack[-1][3] = True
        before = self.seen < len(self.known)
        seq = self.known[self.seen] if before else self.block + self.seen - len(self.known)
        self.seen += 1
        self.stack.append([seq, tag, [], False, {}, before])

    def data(self, text: str) -> None:
        if self.stack and not self.stack[-1][3]:
            self.stack[-1][2].append(text)

    def end(self, tag: str) -> None:
        seq, tag, pieces, _, texts, before = self.stack.pop()
        text = "".join(pieces)
        if self.stack:
            if not self.flat:
                if text.strip():
                    self.stack[-1][4][tag] = text
            elif len(self.stack) == 2:
                self.stack[-1][4][short_name(tag).lower()] = text
        if before:
            self.cross(seq, tag, texts, len(self.stack))
        elif len(self.stack) == 1 if self.flat else texts:
            self.rows.append((seq, tag, json.dumps(texts), None, None, "row"))

    def cross(self, seq: int, tag: str, texts: dict, depth: int) -> None:
        if self.flat and depth == 1:
            self.rows.append((seq, tag, None, None, None, "part"))
        self.rows.extend((seq, tag, None, name, text, "part") for name, text in texts.items())

    def finish(self) -> None:
        """What the elements still open have had so far."""
        for depth, (seq, tag, _, _, texts, _) in enumerate(self.stack):
            self.cross(seq, tag, texts, depth)

    def close(self) -> None:
        pass


def cutter(flat: bool):
    """The second pass: rows of the elements of each split, and a row of kind ``bad`` where the parser refuses it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parser, target, row, alone, loose, refused = None, None, None, None, False, 0, False
        out, held = [], 0

        def add(rows: list[tuple]) -> None:
            nonlocal held
            case, evidence, path, block = row
            out.extend((case, evidence, path, seq, tag, record, block, name, text, kind) for seq, tag, record, name, text, kind in rows)
            held += sum(len(record or "") + len(text or "") for _, _, record, _, text, _ in rows)

        def made() -> pa.RecordBatch:
            nonlocal held
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["case_id", "evidence_id", "path", "seq", "tag", "record", "block", "name", "text", "kind"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            held = 0
            return batch

        def feed(data: bytes) -> None:
            nonlocal refused
            try:
                parser.feed(data)
                if hasattr(parser, "flush"):
                    parser.flush()
            except ET.ParseError:
                refused = True

        def last() -> None:
            nonlocal refused
            if alone and not refused:
                try:
                    parser.close()
                except ET.ParseError:
                    refused = True
            if refused:
                add([(None, None, None, None, None, "bad")])
                return
            target.finish()
            add(target.rows + [(None, None, None, None, None, "loose")] * loose)

        for batch in batches:
            for item in batch.to_pylist():
                if (item["path"], item["block"]) != now:
                    if now:
                        last()
                    now, loose, refused = (item["path"], item["block"]), 0, False
                    row = item["case_id"], item["evidence_id"], item["path"], item["block"]
                    alone, target = item["alone"], Elements(flat, item["block"], item["known"])
                    parser = ET.XMLParser(target=target)
                    feed(item["replay"])
                    if item["done"] and target.stack:
                        target.stack[-1][3] = True
                data = item["text"]
                # What follows the last end sign of a file comes with one that the file does not have.
                last_piece = data.rfind(END.encode(), 0, -1) + 1 if not item["ended"] else len(data)
                for piece in (data[:last_piece], data[last_piece:]):
                    if refused or not piece:
                        continue
                    if piece is not data and not target.stack and not piece[:-1].strip(b" \t\r\n"):
                        loose += 1
                    else:
                        feed(piece)
                if not refused:
                    add(target.rows)
                    target.rows.clear()
                if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield made()
        if now:
            last()
        if out:
            yield made()

    return cut


def elements(pieces: DataFrame, states: DataFrame, flat: bool) -> DataFrame:
    """Rows of kind ``row`` (whole elements), ``part`` (texts of elements that cross splits), ``bad`` and ``loose``."""
    packed = pieces.select("case_id", "evidence_id", "path", "block", "text").mapInArrow(pack, PACKED)
    same = (F.col("path") == F.col("of_path")) & (F.col("block") == F.col("of_block"))
    ready = packed.join(broadcast_if_small(states.where("fault IS NULL"), BROADCAST_SPLITS), same)
    columns = ["case_id", "evidence_id", "path", "block", "part", "text", "replay", "known", "done", "ended", "alone"]
    return ready.select(*columns).sortWithinPartitions("path", "block", "part").mapInArrow(cutter(flat), FOUND)


def unfit(found: DataFrame, states: DataFrame) -> DataFrame:
    """Paths of files that are not well formed: refused, or with more than blanks after the last end sign."""
    tails = found.where("kind = 'loose'").groupBy("path").agg(F.count("*").alias("tails"))
    loose = states.where("fault IS NULL AND NOT ended").select(F.col("of_path").alias("path")).distinct().join(tails, "path", "left")
    return found.where("kind = 'bad'").select("path").unionByName(loose.where("coalesce(tails, 0) <> 1").select("path")).distinct()


def put_together(found: DataFrame) -> DataFrame:
    """case_id, evidence_id, path, seq, tag, record of all elements, those that cross splits made from their parts."""
    plain = ["case_id", "evidence_id", "path", "seq", "tag"]
    texts = found.where("kind = 'part'").groupBy(*plain, "name").agg(F.max_by("text", "block").alias("text"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "text"))
    crossing = texts.groupBy(*plain).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("record"))
    return found.where("kind = 'row'").select(*plain, "record").unionByName(crossing)
