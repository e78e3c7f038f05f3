"""XML documents cut into their elements by many tasks, against one parser over the whole document."""

import io
import json
import random
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest

from casewise.sources import xml_pieces
from casewise.sources.files import Origin
from casewise.sources.xml_files import read_elements, read_xml_events

HERE = Origin(case_id=1, evidence_id=2)
TEXTS = ["plain", " ", "", "a > b", "&lt;b&gt;", "<![CDATA[<x> ]] > </y>]]>", "x<!-- <z> > ' \" -->y", "é 日本 🙂", "<?note a > 'b ?>", "it's \"so\"", "&#65;\n"]
NAMES = ["Time", "user", "Host", "n:code", "deep"]
VALUES = ['"a > b"', "'it\"s > '", '"it\'s"', '""']


def element(rng, depth=0):
    name = rng.choice(NAMES)
    attributes = "".join(f" k{k}={rng.choice(VALUES)}" for k in range(rng.randint(0, 2)))
    if rng.random() < 0.15:
        return f"<{name}{attributes} />"
    inside = rng.choice(TEXTS) * rng.choice([1, 1, 1, 60])
    for _ in range(rng.randint(0, 3) if depth < 4 else 0):
        inside += element(rng, depth + 1) + rng.choice(TEXTS)
    return f"<{name}{attributes}>{inside}</{name} >"


def document(rng, n):
    inner = "".join(element(rng) + rng.choice(["\n", "", "t", "<!-- > -->"]) for _ in range(n))
    return f'<?xml version="1.0"?>\n<!-- top > --><log xmlns:n="urn:n" xmlns="urn:x" note="a > b">head{inner}</log>'


def expected(content, flat):
    """(tag, texts) of the elements in document order, from a tree."""
    try:
        root = ET.parse(io.BytesIO(content)).getroot()
    except ET.ParseError:
        return []
    if flat:
        return [(e.tag, {c.tag.split("}")[-1].lower(): c.text or "" for c in e}) for e in root]
    found = [(e.tag, {c.tag: c.text for c in e if (c.text or "").strip()}) for e in root.iter()]
    return [(tag, texts) for tag, texts in found if texts]


def read(spark, path, flat):
    rows = read_elements(spark, str(path), HERE, flat).orderBy("seq").collect()
    assert len({(r.path, r.seq) for r in rows}) == len(rows)
    return [(r.tag, json.loads(r.record)) for r in rows]


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("flat", [False, True])
def test_splits_cut_comments_sections_attributes_and_nested_elements(small_splits, tmp_path, flat):
    rng = random.Random(5)
    content = document(rng, 30).encode()
    (tmp_path / "big.xml").write_bytes(content)
    assert small_splits.read.text(str(tmp_path), lineSep=">").rdd.getNumPartitions() > 12
    want = expected(content, flat)
    assert len(want) > 15 and read(small_splits, tmp_path, flat) == want
    assert read_xml_events(small_splits, str(tmp_path), HERE, "flat" if flat else "standard").count() == len(want)


LONG = "<a>" + "<b><c>1</c></b>\n" * 80
MALFORMED = {
    "open": LONG, "name": LONG + "</b>", "two_roots": LONG + "</a>" + "<a></a>", "after": LONG + "</a>x", "sign_after": LONG + "</a>\n>",
    "sign_before": "\n>" + LONG + "</a>", "closed": LONG + "</a></a>", "comment": LONG + "</a><!-- --", "attribute": LONG + '<b k="<"></b></a>',
    "entity": LONG + "<b>&none;</b></a>", "middle": LONG + "</b>" + LONG + "</a>", "prefix": LONG + "<q:b/></a>", "empty": "", "none": "text", "tail_root": LONG + "</a",
}


def test_a_document_that_is_not_well_formed_has_no_elements(small_splits, tmp_path):
    for name, content in MALFORMED.items():
        assert expected(content.encode(), False) == [], name
        (tmp_path / f"{name}.xml").write_text(content)
    assert read(small_splits, tmp_path, False) == []
    for name, tail in {"plain": "", "lines": "\n\n", "comment": "<!-- > -->\n"}.items():
        (tmp_path / f"good-{name}.xml").write_text(LONG + "</a>" + tail)
    rows = read_elements(small_splits, str(tmp_path), HERE, False).groupBy("path").count().collect()
    assert sorted((r.path.rsplit("/", 1)[1], r["count"]) for r in rows) == [(f"good-{n}.xml", 80) for n in ("comment", "lines", "plain")]


def test_encodings_and_types(small_splits, tmp_path):
    body = "<log>" + "<e><user>é&who;</user><big>%s</big></e>" % ("x" * 300) * 8 + "</log>"
    kind = '<!DOCTYPE log [<!-- it\'s ]> --><!ENTITY who "ann > bob">]>'
    plain = body.replace("&who;", "")
    files = {
        "latin": ('<?xml version="1.0" encoding="iso-8859-1"?>' + plain).encode("latin-1"),
        "utf16": ('<?xml version="1.0" encoding="utf-16"?>' + plain).encode("utf-16"),
        "mark": b"\xef\xbb\xbf" + plain.encode(),
        "kind": (kind + body).encode(),
        "long_kind": (kind.replace("[", "[" + '<!ENTITY other "a > b">' * 60, 1) + body).encode(),
    }
    for name, content in files.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.xml").write_bytes(content)
        for flat in (name == "kind",):
            want = expected(content, flat)
            assert len(want) == 8 and read(small_splits, folder, flat) == want, name


def test_an_element_with_texts_in_many_splits_is_one_row(small_splits, tmp_path):
    content = "<log>head" + "".join(f"<k{i % 7}>{i}</k{i % 7}>\n<z/>" for i in range(400)) + "</log>\n"
    (tmp_path / "wide.xml").write_text(content)
    want = expected(content.encode(), False)
    assert len(want) == 1 and read(small_splits, tmp_path, False) == want


def test_states_at_every_border():
    """Cut anywhere after an end sign, the notes of the pieces lead to the notes of the whole."""
    rng = random.Random(8)
    content = document(rng, 12).encode()
    whole = xml_pieces.Note(b"")
    whole.take(content)
    assert whole.row()["opened"] == [] and whole.pops == 0
    for end in [k + 1 for k in range(len(content)) if content[k : k + 1] == b">"][:-1]:
        first = xml_pieces.Note(b"")
        first.take(content[:end])
        second = xml_pieces.Note(xml_pieces.STARTS[xml_pieces._start_of(first.pending)])
        second.take(content[end:])
        assert (first.fault, second.fault) == (None, None)
        assert second.pops == len(first.opened) and first.number + second.number == whole.number and not second.pending


def test_small_files_leave_a_task_together():
    """Notes and elements of many small files are one batch; a file of one split needs no note, other first splits one for one start."""
    texts = b"<l><e><a>x</a></e></l>".split(b">")[:-1]
    rows = [{"path": f"{k}.xml", "block": 0, "text": t, "size": 22} for k in range(3) for t in texts]
    notes = list(xml_pieces.summarize(iter([pa.RecordBatch.from_pylist(rows[:8]), pa.RecordBatch.from_pylist(rows[8:])])))
    assert len(notes) == 1 and [(len(r["notes"]), r["bytes"]) for r in notes[0].to_pylist()] == [(0, 22)] * 3
    (part,) = list(xml_pieces.summarize(iter([pa.RecordBatch.from_pylist([{**r, "size": 30} for r in rows[:3]])])))
    assert [len(r["notes"]) for r in part.to_pylist()] == [1]
    states = list(xml_pieces.single_states(iter(notes)))
    assert len(states) == 1 and [(r["of_path"], r["ended"], r["fault"]) for r in states[0].to_pylist()] == [(f"{k}.xml", True, None) for k in range(3)]
    items = [
        {"case_id": 1, "evidence_id": k, "path": f"{k}.xml", "block": 0, "part": 1, "text": b"<l><e><a>x</a></e></l>", "replay": b"", "known": [], "done": False, "ended": True, "alone": True}
        for k in range(3)
    ]
    schema = pa.schema([("case_id", pa.int64()), ("evidence_id", pa.int64()), ("path", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("text", pa.binary()),
                        ("replay", pa.binary()), ("known", pa.list_(pa.int64())), ("done", pa.bool_()), ("ended", pa.bool_()), ("alone", pa.bool_())])
    found = list(xml_pieces.cutter(True)(iter([pa.RecordBatch.from_pylist(items, schema)])))
    assert len(found) == 1 and [(r["evidence_id"], r["tag"], r["record"]) for r in found[0].to_pylist()] == [(k, "e", '{"a": "x"}') for k in range(3)]


def test_only_files_of_several_splits_are_grouped(spark):
    """A file whose first split has all its bytes is walked where it is; the states are those of grouping all files."""
    note = {"pops": 0, "lead": b"", "touched": True, "opened": [], "pending": b"", "prolog": b"", "fault": None}
    opened = {**note, "opened": [{"raw": b"<l>", "number": 0, "text": b"", "done": True}]}
    rows = [("a", 0, b"<l>", 10, 10, [note]), ("b", 0, b"<l>", 6, 10, [opened]), ("b", 6, b"", 4, 10, [{**note, "pops": 1}] * 6), ("c", 0, b"<l>", 10, 13, [note]), ("d", 0, b"<l>", 11, 10, [note])]
    splits = spark.createDataFrame([(*r[:5], [tuple(n.values()) for n in r[5]]) for r in rows], xml_pieces.SPLITS_TYPE)
    plain = splits.groupBy("path").applyInArrow(xml_pieces.states_of, xml_pieces.STATES_TYPE)
    got = sorted((r["of_path"], r["of_block"], bytes(r["replay"]), r["ended"], r["fault"]) for r in xml_pieces.states(splits).collect())
    assert got == sorted((r["of_path"], r["of_block"], bytes(r["replay"]), r["ended"], r["fault"]) for r in plain.collect())
    assert len(got) == 5


def test_small_files_are_checked_to_their_end(spark, tmp_path):
    """Without notes it is the parser that refuses a root left open, text after the root, and an empty document."""
    texts = ["<l><e><a>x</a></e></l>", "<l><e><a>x</a></e></l>\n\n", "<l><e><a>x</a></e>", "<l><e><a>x</a></e></l", "<l><e><a>x</a></e></l>tail", "<!-- x -->", "<l><e><a>x</a></e></l><m/>", ""]
    for k, text in enumerate(texts):
        folder = tmp_path / f"case_id=1/evidence_id={k}"
        folder.mkdir(parents=True)
        (folder / "a.xml").write_text(text)
    for flat in (True, False):
        got = read_elements(spark, str(tmp_path), Origin(), flat).collect()
        assert sorted((r["evidence_id"], r["tag"]) for r in got) == [(0, "e"), (1, "e")]
