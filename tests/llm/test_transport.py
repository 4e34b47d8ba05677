"""Timestamps and random-access points are stored with the media and lead into the stream."""

from varileaf.llm import transport
from varileaf.llm.common import materialize


def test_index(spark):
    texts = ["", None, "a b c", "xy " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = materialize(transport.encode_media(docs), "media")
    media = {r.doc_id: r for r in stored.collect()}
    for r in transport.read_media(stored).collect():
        units = -(-r.payload_bytes // transport.AU)
        assert r.pts == media[r.doc_id].pts == [k * transport.CLOCK // transport.RATE for k in range(units)] and r.pts[-1] == r.last_pts
        assert r.random_access == media[r.doc_id].random_access
        assert [(p.access_unit, p.pts) for p in r.random_access] == [(k, r.pts[k]) for k in range(0, units, transport.GROUP)]
        for p in r.random_access:  # from each point on, with the tables, the rest of the payload can be read
            raw = bytes(media[r.doc_id].media)
            assert transport.Demuxed(transport.TABLES + raw[p.byte_offset :]).pts == r.pts[p.access_unit :]
