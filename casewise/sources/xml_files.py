"""Reader of general XML files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise import taxonomy as X
from casewise.functions.events import pick_from_map, universal_event
from casewise.functions.timestamps import iso_to_utc
from casewise.operators.skew import broadcast_if_small
from casewise.session import materialize
from casewise.sources import xml_pieces
from casewise.sources.files import Origin, literal_path, read_contents, read_lines

ELEMENTS = "case_id long, evidence_id long, path string, seq long, tag string, record string"
CHUNK = 1 << 20
LISTED = 1000


def elements_of(content: bytes, flat: bool) -> list[tuple[int, str, str]]:
    """(position, tag, child texts as JSON) of the elements of one document held as bytes, in document order.

    Not flat: every element that has children with text. Flat: the children of the root, with
    their own children under short lower-case names. A document that is not well formed gives none.
    """
    target = xml_pieces.Elements(flat, 0, [])
    parser = ET.XMLParser(target=target)
    try:
        for start in range(0, len(content), CHUNK):
            parser.feed(content[start : start + CHUNK])
        parser.close()
    except ET.ParseError:
        return []
    return sorted(row[:3] for row in target.rows)


def whole_elements(files: DataFrame, flat: bool) -> DataFrame:
    """Elements of the XML files that cannot be cut at ``>``, held as bytes."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = pd.DataFrame(elements_of(bytes(row.content), flat), columns=["seq", "tag", "record"])
                found.insert(0, "path", row.path)
                found.insert(0, "evidence_id", row.evidence_id)
                found.insert(0, "case_id", row.case_id)
                yield found

    return files.select("case_id", "evidence_id", "path", "content").mapInPandas(explode, ELEMENTS)


def read_elements(spark: SparkSession, path, origin: Origin, flat: bool, glob: str | None = None) -> DataFrame:
    """Elements of XML files, each file read by as many tasks as it has splits.

    Files in UTF-16, and those whose type declaration goes over the border of a split, are parsed whole by one task each.
    """
    pieces = read_lines(spark, path, origin, glob, separator=xml_pieces.END, keep_block=True)
    pieces = pieces.withColumn("text", F.col("line").cast("binary"))
    splits = materialize(pieces.select("path", "block", "size", "text").mapInArrow(xml_pieces.summarize, xml_pieces.SPLITS_TYPE), "xml-splits")
    states = materialize(xml_pieces.states(splits), "xml-states")
    found = materialize(xml_pieces.elements(pieces, states, flat), "xml-elements")
    kept = found.join(broadcast_if_small(xml_pieces.unfit(found, states)), "path", "left_anti")
    cut = xml_pieces.put_together(kept)
    chosen = states.where("fault = 'whole'").select(F.col("of_path").alias("path"))
    listed = [r.path for r in chosen.limit(LISTED + 1).collect()]
    if not listed:
        return cut
    # So many files are named to the scan; of more, all files are scanned for them.
    named = (([literal_path(p) for p in listed], None) if len(listed) <= LISTED else (path, glob))
    files = read_contents(spark, named[0], origin, named[1]).join(broadcast_if_small(chosen), "path", "left_semi")
    return cut.unionByName(whole_elements(files, flat))


def element_events(elements: DataFrame, origin: Origin) -> DataFrame:
    fields = {
        "source": F.lit("XmlLog"),
        "event_type": F.col("tag"),
        "description": F.concat(F.lit("XML node <"), F.col("tag"), F.lit("> parsed")),
        "raw_data": F.parse_json("record"),
    }
    return universal_event(elements, fields, origin.ingest_time())


def flat_events(elements: DataFrame, origin: Origin) -> DataFrame:
    rows = elements.withColumn("fields", F.from_json("record", "map<string,string>"))

    def pick(field: str):
        return pick_from_map(F.col("fields"), X.XML_FLAT_ALIASES[field])

    fields = {name: pick(name) for name in X.XML_FLAT_ALIASES if name != "timestamp"}
    fields["timestamp"] = iso_to_utc(pick("timestamp"))
    fields["source"] = F.lit("XML Log")
    fields["event_type"] = F.coalesce(fields["event_type"], F.col("tag"))
    fields["description"] = F.coalesce(fields["description"], F.concat(F.lit("XML element "), F.col("tag")))
    fields["raw_data"] = F.parse_json("record")
    return universal_event(rows, fields, origin.ingest_time())


def read_xml_events(
    spark: SparkSession, path, origin: Origin, profile: str = "standard", glob: str | None = None
) -> DataFrame:
    """Events of XML files; ``profile="flat"`` reads only the children of the root."""
    flat = profile == "flat"
    elements = read_elements(spark, path, origin, flat, glob)
    return flat_events(elements, origin) if flat else element_events(elements, origin)
