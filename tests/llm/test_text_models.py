import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_extraction, licenses, toxicity
from quillspark.llm.html_blocks import leaf_blocks
from quillspark.llm.html_pages import labelled_pages
from tests.compare import DATA, same

from . import site_styles
from .cases import by_id, frame, odd_rows

# licences


def test_licenses_match_sql(spark):
    same(licenses.op1_license_scan(spark, DATA), licenses.ORACLE_SQL)


def test_licenses_run_without_python(spark):
    plan = licenses.op1_license_scan(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize(
    ("text", "ids", "names"),
    [
        ("x. Released under the  MIT license! y", "mit-notice", "MIT"),
        ("RELEASED UNDER THE MIT LICENSE.\nLicensed under CC BY-NC 4.0.", "mit-notice>cc-by-nc4-notice", "CC-BY-NC-4.0,MIT"),
        ("You may not use this file except in compliance with the License. Hm. You may obtain a copy of the License at\nhttp://x", "apache2-comply>apache2-copy", "Apache-2.0"),
        ("You may obtain a copy of the License at\nYou may not use this file except in compliance with the License.", "apache2-copy>apache2-comply", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl2-notice", "MPL-2.0"),
        ("not Released under the MIT License.", "", ""),
        ("MIT License\nAll rights reserved.", "mit-title>all-rights", ""),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_license_rules(spark, text, ids, names):
    row = licenses.scan(frame(spark, [(1, text)])).first()
    assert (row.sentence_ids, row.licenses, row.n_sentences) == (ids, names, ids.count(">") + 1 if ids else 0)


MIT = """MIT License

Copyright (c) 2024 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
BSD3 = """Copyright (c) 2024, A Name
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_whole_wrapped_licenses(spark):
    texts = {"MIT": MIT, "ISC": ISC, "BSD-3-Clause": BSD3, "GPL-3.0": GPL3}
    rows, want = [], []
    for name, text in texts.items():
        flowed = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        commented = "/*\n" + "\n".join(f" * {line}".rstrip() for line in text.split("\n")) + "\n */"
        for form in (text, flowed, commented, text.replace("\n", "\r\n")):
            rows.append((len(rows), form))
            want.append((len(want), name))
    parted = MIT.replace("documentation files", "documentation\n\nfiles")  # another paragraph is another sentence
    got = licenses.scan(frame(spark, [*rows, (len(rows), parted)]))
    assert sorted((r.doc_id, r.licenses) for r in got.collect()) == [*want, (len(want), "")]
    assert licenses.scan(frame(spark, [(1, MIT)])).first().sentence_ids == "mit-title>mit-grant>mit-condition>as-is"


WHOLE = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("GPL-2.0-or-later", GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")),
    ("LGPL-2.1-or-later", GPL3.replace("This program", "This library").replace("software: you", "software; you").replace("GNU General", "GNU Lesser General").replace("Foundation, either version 3", "Foundation; either version 2.1")),
    ("AGPL-3.0-or-later", GPL3.replace("GNU General", "GNU Affero General")),
    ("BSD-2-Clause", BSD3[: BSD3.index("3. Neither")] + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED\nWARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT"),
    ("BSD-3-Clause", BSD3 + "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED\nWARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
]


TITLES = [
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"),
    ("GPL-2.0", "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n"),
    ("EPL-2.0", "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS"),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0"),
    ("MIT", "<div class='foot'><p>Released under the MIT License.</p></div>"),
    ("CC-BY-4.0", "<P>This work is licensed under the Creative Commons\nAttribution 4.0 International License.<br/>More text"),
    ("", "We follow the GNU General Public License version 3 of 29 June 2007 and the Apache License in version 2.0, January 2004 or later."),
    ("", "<p Released under the MIT License. " + "<" * 5_000 + "a" * 100_000),
]


def test_titles_of_whole_licenses_and_notices_in_markup(spark):
    got = licenses.scan(frame(spark, list(enumerate(text for _, text in TITLES))))
    assert [r.licenses for r in sorted(got.collect())] == [name for name, _ in TITLES]


def test_more_license_headers_as_comments(spark):
    rows, want = [], []
    for name, text in WHOLE:
        for mark in ("", "// ", "# ", " * "):
            rows.append((len(rows), "\n".join((mark + line).rstrip() for line in text.split("\n"))))
            want.append((len(want), name))
    assert sorted((r.doc_id, r.licenses) for r in licenses.scan(frame(spark, rows)).collect()) == want


def test_licenses_odd_rows(spark):
    assert by_id(licenses.scan(frame(spark, odd_rows()))) == sorted(((i, "", "", 0) for i, _ in odd_rows()), key=repr)
    assert licenses.scan(frame(spark, [])).count() == 0


# toxicity


@pytest.mark.parametrize("text", ["You IDIOT", "you 1d10t!", "you idіоt", "you ｉｄｉｏｔ", "id​iot", "l0ser", "$tup1d", "tr4sh", "ídiot", "i\u0301diot", "idi\u0336ot", "İDIOT", "!diot", "stup!d!", "mørøn", "łoser", "tra\u0336sh"])
def test_folding_undoes_disguise(text):
    machine = toxicity.Model({f"{toxicity.fold(w).rstrip()} ": 4.0 for w in toxicity.SEEDS}).machine()
    assert len(toxicity.matched(machine, toxicity.fold(text))) == 1


@pytest.mark.parametrize("text", [None, "", "the class clown", "a clown fish.", "trash can", "idiotic", "0 1 2"])
def test_exceptions_and_longer_words_do_not_count(text):
    model = toxicity.Model({f"{toxicity.fold(w).rstrip()} ": 4.0 for w in toxicity.SEEDS}, [toxicity.fold(p) for p in toxicity.EXCEPTIONS])
    assert toxicity.matched(model.machine(), toxicity.fold(text)) == []


def test_marks_of_other_words_and_stops_stay():
    assert toxicity.fold("が réeux") == " が réeux " and toxicity.fold("ga!! GA! no.") == " ga   ga  no  "


def test_matches_equal_a_naive_search():
    rng = random.Random(4)
    for _ in range(400):
        entries = {" " + "".join(rng.choices("ab", k=rng.randint(1, 3))) + rng.choice([" ", ""]): rng.choice([1.0, 2.0, 3.0]) for _ in range(4)}
        phrases = [f" {' '.join(''.join(rng.choices('ab', k=rng.randint(1, 2))) for _ in range(2))} " for _ in range(2)]
        model = toxicity.Model(entries, phrases)
        text = toxicity.fold(" ".join("".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(12)))
        spans = [(i, i + len(p) - 1) for p in phrases for i in range(len(text)) if text.startswith(p, i)]
        want = {}
        for i in range(len(text)):
            found = [(w, i + len(e) - 1) for e, w in entries.items() if text.startswith(e, i)]
            if found:
                weight = max(w for w, _ in found)
                want[i] = (weight, {e for w, e in found if w == weight})
        got = {s: (e, w) for s, e, w in toxicity.matched(model.machine(), text)}
        for i, (weight, ends) in want.items():
            outside = {e for e in ends if not any(a <= i and e <= b + 1 for a, b in spans)}
            if i in got:
                assert got[i][1] == weight and got[i][0] in ends and got[i][0] in outside
            else:
                assert outside != ends
        assert set(got) <= set(want)


def test_longer_clean_text_lowers_the_score():
    machine = toxicity.Model({" idiot ": 4.0}).machine()
    short, long = (toxicity.features(machine, toxicity.fold("you idiot " + "word " * n)) for n in (1, 500))
    assert short[0] == long[0] and short[1] > long[1]


def test_held_out_accuracy(spark):
    sf = DATA.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.op2_toxicity(spark, sf)
    assert out.count() == docs.count()
    rows = out.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.kept(docs, toxicity.Model({" idiot ": 9.0}, [], (-5.0, 9.0, 0.0, 0.0))).columns == docs.columns


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert (a.weights, a.exceptions, a.curve) == (b.weights, b.exceptions, b.curve)


def test_toxicity_odd_rows(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted((i for i, _ in odd_rows()), key=repr)
    empty = {r.score for r in got.where("doc_id IN (4, 5, 6)").collect()}
    assert len(empty) == 1 and empty.pop() < 0.1
    assert toxicity.score(frame(spark, []), toxicity.learn(frame(spark, []), labels.limit(0))).count() == 0
    assert toxicity.kept(docs, model).count() == len(odd_rows())


# pages


def test_leaf_blocks():
    page = "<title>no</title><body><p>One &amp; two<br>three<p>four <b>five<ul><li>six<li>se<i>v</i>en</ul><!-- c --><script>var x='</p>'</script><div class='Ad-box'>eight\n\t nine</div>ten &lt;b&gt;"
    blocks = leaf_blocks(page)
    assert [b[0] for b in blocks] == ["One & two three", "four five", "six", "seven", "eight nine", "ten <b>"]
    assert blocks[2][1][-2:] == (("ul", ()), ("li", ()))
    assert ("div", ("ad", "box")) in blocks[4][1]
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<p></p> ") == []
    assert [b[0] for b in leaf_blocks("a < b <p unclosed")] == ["a < b <p unclosed"]
    assert len(leaf_blocks("<p>x" * 3000)) == 3000


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p data-x=don't>Hello world</p><div class='ad'>AD</div><p>It's here</p>", ["Hello world", "AD", "It's here"]),
        ("a < b <é> 3</3 <p title=\"x > y\" class=k>T</p>", ["a < b <é> 3</3", "T"]),
        ("<p x=\"unclosed>Q</p>r", ["Q", "r"]),
        ("<p>one</p><p x='>two", ["one", "two"]),
        ("<p>one</p><a href=x <!-- y", ["one", "<a href=x"]),
        ("<p>one</p><!-- two <p>three</p>", ["one"]),
        ("<!-->a<!-- b -->c<!DOCTYPE x>d<?php e ?>f", ["acdf"]),
        ("<style>p{}</style >a<script>'</p>'</script x>b", ["ab"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<a href=http://x/?a='b>c</a> d", ["c d"]),
    ],
)
def test_leaf_blocks_of_bad_markup(page, texts):
    assert [b[0] for b in leaf_blocks(page)] == texts


@pytest.mark.parametrize("unit", ["<p x ", "<p x='>' ", '<a x="', "<div>a", "<div></ul>", "<span class=q><p>", "<li><span class=a>", "<!-- ", "<!x ", "<style>a", "<textarea>", "<", "&amp", "<p =", "<svg>a", "</div>", "<td>", "</p", "<table><tr><td>"])
def test_leaf_blocks_read_bad_pages_once(unit):
    took = []
    for n in (125_000, 1_000_000):
        page = unit * (n // len(unit)) + "<p>'\">"
        began = time.process_time()
        leaf_blocks(page)
        took.append(time.process_time() - began)
    assert took[1] < max(2.0, 24 * took[0]), took


def test_main_text_of_pages_by_hand():
    chain = html_extraction.default_chain()
    pages = [
        ("<body><h1>Title here</h1><p>First paragraph of the text, it is long enough.</p>\n<p>Second   paragraph\nfollows here.</p></body>", "Title here\nFirst paragraph of the text, it is long enough.\nSecond paragraph follows here."),
        ("<nav><a href='/'>Home</a> <a href='/n'>News</a></nav><div class='story'><h1>A storm</h1><p class='byline'>By Jane Doe</p><p>The text of the story goes on for a while.</p><div class='signup'><h3>Get our letter</h3><p>Sign up for news.</p><input><button>Go</button></div><p>More text of it, &amp; an end.</p></div><footer>&copy; 2024 A paper</footer>", "A storm\nBy Jane Doe\nThe text of the story goes on for a while.\nMore text of it, & an end."),
        ("<p>Hello there, this is it.</p><p>And more of it.</p>", "Hello there, this is it.\nAnd more of it."),
        ("<header><a href='/'>Site</a></header><main><article><h1>Head</h1><p>Text one is here, as it is.</p><ul><li>First point<li>Second point</ul><blockquote><p>Said somebody, once.</p></blockquote></article><section id='comments'><h3>2 comments</h3><div class='comment'><p>I do not agree at all.</p></div></section></main><aside class='sidebar'><h4>Popular</h4><ul><li><a href='/p'>Other news</a></ul></aside>", "Head\nText one is here, as it is.\nFirst point\nSecond point\nSaid somebody, once."),
        ("<div class='cookie-notice'><p>We use cookies.</p><button>Fine</button></div><div id='post-12'><h2>Soup</h2><p>Cut the leeks and fry them.</p><pre>1 leek\n2 eggs</pre></div><form action='/s'><label>Search</label><input></form>", "Soup\nCut the leeks and fry them.\n1 leek 2 eggs"),
    ]
    for page, want in pages:
        assert html_extraction.main_text(page, chain) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div id='content'><h1>潮の話</h1><p>港では毎日その時刻を記している。</p><p>夏の夜には、潮の音がよく聞こえる。</p></div>", "潮の話\n港では毎日その時刻を記している。\n夏の夜には、潮の音がよく聞こえる。"),
        ("<div class='article__text'>First part of the story.<br>Second line.</div>", "First part of the story. Second line."),
        ("<article><p>Yes.</p></article>", "Yes."),
        ("<div class=post-body><p>AA</p><div class='ad-slot'>Buy our boats today!</div><p>AA</p></div>", "AA\nAA"),
        ("<article><h1>Boats</h1><p>AA</p><div class='newsletter'><p>Sign up for our letter.</p></div><p>AA</p></article>", "Boats\nAA\nAA"),
        ("<div class='top-menu'><a href='/'>Главная</a> | <a href='/n'>Новости</a></div><div class='news-text'><h1>Порт</h1><p>Работы в порту займут больше времени.</p><p>Мэр обещал помощь.</p></div><div class='footer'>Все права защищены.</div>", "Порт\nРаботы в порту займут больше времени.\nМэр обещал помощь."),
    ],
)
def test_main_text_of_other_scripts_short_and_broken_articles(page, want):
    long = " ".join(["The harbour master said that repairs would take longer than planned."] * 6)
    assert html_extraction.main_text(page.replace("AA", long), html_extraction.default_chain()) == want.replace("AA", long)


def test_blocks_of_site_styles_not_trained_on():
    chain, wrong, total, whole = html_extraction.default_chain(), 0, 0, 0
    for name in site_styles.names():
        page, want = site_styles.page(name)
        blocks, said = leaf_blocks(page), set(want.split("\n"))
        got = chain.decode([chain.emission(p, t, n) for t, p, n, _ in blocks])
        wrong += sum((b[0] in said) != label for b, label in zip(blocks, got, strict=True))
        total += len(blocks)
        whole += html_extraction.main_text(page, chain) == want
    assert total == 77 and wrong <= 3
    assert whole >= 7


def test_embedded_and_unclosed_elements_keep_their_text():
    said = lambda page: [b[0] for b in leaf_blocks(page)]
    for tag in ("math", "object", "audio", "video", "canvas", "svg", "iframe", "noscript"):
        assert said(f"<p>one <{tag} x='1'>two</{tag}> three</p><p>four") == ["one two three", "four"]
        assert said(f"<p>one</p><{tag}><p>two</p><article><p>three</p></article>") == ["one", "two", "three"]
        path = [x[0] for x in leaf_blocks(f"<article><p>one <{tag}>two</{tag}> three</p>")[0][1]]
        assert path == ["article", tag, "p"]
    for tag in ("script", "style", "template"):
        assert said(f"<p>one <{tag}>x = '</p>'</{tag}>two</p>three") == ["one two", "three"]
    for tag in ("style", "template", "title", "textarea"):
        assert said(f"<{tag}><article><p>one</p></article>")[-1] == "one"
    assert said("<p>one</p><script>two<p>three</p>") == ["one"]


def test_blocks_on_pages_not_trained_on():
    chain = html_extraction.default_chain()
    wrong = total = 0
    for page, labels in labelled_pages(150, seed=1234):
        got = chain.decode([chain.emission(p, t, n) for t, p, n, _ in leaf_blocks(page)])
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_viterbi_is_the_best_of_all_sequences():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(30):
        chain = html_extraction.Chain({}, rng.normal(size=(2, 2)), rng.normal(size=2))
        e = rng.normal(size=rng.integers(1, 8)).tolist()
        score = lambda y: chain.begin[y[0]] + sum(x for x, k in zip(e, y, strict=True) if k) + sum(chain.step[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert chain.decode(e) == list(max(itertools.product([0, 1], repeat=len(e)), key=score))


def test_gradient_is_that_of_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(3)
    e, y = rng.normal(size=(3, 4)), rng.integers(0, 2, (3, 4))
    there = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    step, begin = rng.normal(size=(2, 2)), rng.normal(size=2)

    def loss(e, step, begin):
        import itertools

        total = 0.0
        for i in range(3):
            n = there[i].sum()
            s = lambda k: begin[k[0]] + sum(e[i, t] for t in range(n) if k[t]) + sum(step[a, b] for a, b in itertools.pairwise(k))  # noqa: B023, E731
            total += np.logaddexp.reduce([s(k) for k in itertools.product([0, 1], repeat=n)]) - s(y[i, :n])
        return total

    de, ds, db = html_extraction._gradient(e, y, there, step, begin)
    h = 1e-6
    for value, grad in ((e, de), (step, ds), (begin, db)):
        for at in np.ndindex(value.shape):
            value[at] += h
            up = loss(e, step, begin)
            value[at] -= 2 * h
            down = loss(e, step, begin)
            value[at] += h
            assert abs((up - down) / (2 * h) - grad[at]) < 1e-4


def test_extraction_on_the_tables_pages(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in html_extraction.op4_html_extraction(spark, DATA).collect():
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        assert r.text.split() == html.unescape(re.sub("<[^>]*>", " ", inside)).split()
        assert r.n_chars == len(r.text)
        lines = re.sub("</?(?:p|h[1-6]|li|ul|ol|blockquote|div|table|tr|td)[^>]*>", "\x00", re.sub("<br[^>]*>", " ", inside))
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in lines.split("\x00")]
        assert r.text == "\n".join(x for x in blocks if x)


def test_extraction_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>A sentence of an article. Another one follows.</p></article>"), (3, "u", "<nav>"), (3, "u", "<nav>"), (4, "u", "<article>" + "<p>A fairly long paragraph of the story.</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(None).cast("string")).withColumn("n_chars", F.lit("x"))
    got = {(r.page_id, r.url): (r.text.count("\n"), r.n_chars > 0) for r in html_extraction.extract(pages).collect()}
    assert got == {(1, "u"): (0, False), (2, None): (0, False), (None, "u"): (0, True), (3, "u"): (0, False), (4, "u"): (4999, True)}
    assert html_extraction.extract(pages.limit(0)).count() == 0
