"""Inputs that once broke an operator: crashes, hot groups, quadratic work."""

import gzip
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import licenses, packing, warc

from .cases import frame

BSD_3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of {holder} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""


def _names(spark, texts):
    found = licenses.scan(frame(spark, list(enumerate(texts)))).collect()
    return [r.licenses for r in sorted(found, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("line", ["", " ", "\f", "#", " * ", "\r", "--- ///"])
def test_licences_between_very_many_lines_without_words(spark, line):
    lines = f"{line}\n" * 100_000
    assert _names(spark, [f"MIT\n{lines}Released under the MIT License.\n{lines}end"]) == ["MIT"]


@pytest.mark.parametrize("holder", ["Foo Inc.", "the copyright holder", "The University of the\n   Two Rivers, Dept. of Maps", "Ex-Ample & Sons GmbH", "Jane"])
def test_bsd_with_three_clauses_of_any_holder(spark, holder):
    three = BSD_3.format(holder=holder, who=f"{holder.upper()} AND CONTRIBUTORS")
    two = "\n".join(x for x in three.split("\n") if not x.startswith("3.") and "contributors may" not in x and "this software without" not in x)
    assert _names(spark, [three, two]) == ["BSD-3-Clause", "BSD-2-Clause"]


def test_creative_commons_with_the(spark):
    said = "This work is licensed under the Creative Commons Attribution{} 4.0 International License."
    assert _names(spark, [said.format(x) for x in ("", "-ShareAlike", "-NonCommercial")]) == ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_packing_spreads_pieces_of_one_id_or_none(spark, doc_id):
    cut = spark.range(60_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 700 + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    got = packing.pack(cut).toPandas()
    groups = (got["sequence_id"] // (1 << 32)).value_counts()
    assert len(got) == 60_000 and len(groups) == 4 and groups.max() < 1.1 * groups.min()
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048 and len(fill) <= np.ceil(got["length"].sum() / 2048) + len(groups)


@pytest.mark.parametrize("unit", ["<title>", "<title ", "<a x ", "<a ", "<a href='", "<a href ", "<p ", "&", "<!--", "<a><b "])
def test_pages_of_one_broken_tag_take_linear_time(unit):
    page = unit * ((1 << 20) // len(unit))
    began = time.time()
    warc.page_title(page), warc.page_links(page), warc.plain_text(page)
    assert time.time() - began < 2


def test_titles_and_links():
    page = "<TITLE\nx>A &amp; b</title><title>no</title><a\nid=1 HREF = 'x y'>1</a><A href=/q?a=1&b=2>2</A><a name=z>3</a><a href=\"\">4</a><abbr href=no>"
    assert warc.page_title(page) == "A &amp; b"
    assert warc.page_links(page) == ["x y", "/q?a=1&b=2", ""]
    assert warc.page_title("<title>open") is None and warc.page_title("") is None and warc.page_links("") == []


@pytest.mark.parametrize(("coding", "data"), [("gzip", gzip.compress(bytes(5000))), ("deflate", zlib.compress(bytes(5000))), ("deflate", zlib.compress(bytes(5000))[2:-4]), ("identity", bytes(5000))])
def test_payloads_that_grow_too_far_are_errors(coding, data):
    assert warc._inflated(data, coding, 5000) == bytes(5000)
    with pytest.raises(ValueError, match="more than 4999 bytes"):
        warc._inflated(data, coding, 4999)


@pytest.mark.parametrize("data", [zlib.compress(bytes(range(200)))[:-20], gzip.compress(bytes(range(200)))[:-20]])
def test_payloads_that_break_off_are_errors(data):
    with pytest.raises(ValueError):
        warc.body([("Content-Encoding", "deflate" if data[0] == 0x78 else "gzip")], data)
