import re
import time

import numpy as np
import pytest

from tessera.llm import html_text, licenses


def test_base_labels_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pieces = ["CC BY", "cc-by", "by", "cc", "General  Public License", "general public", "ALL rights\nreserved", "all rights", "é", "word", "#", "licence"]
    texts = [None, "", "cc by cc by", "all rights reserved all rights reserved"] + [" ".join(pieces[i] for i in rng.integers(0, len(pieces), int(rng.integers(1, 25)))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def maximal(sequences, text, least):
    """All (end, template, end in it, length) of matches that no word lengthens on either side, by comparing all places."""
    out = set()
    for t, s in enumerate(sequences):
        for i in range(len(text)):
            for j in range(len(s)):
                if i and j and text[i - 1] == s[j - 1]:
                    continue
                n = 0
                while i + n < len(text) and j + n < len(s) and text[i + n] == s[j + n]:
                    n += 1
                if n >= least:
                    out.add((i + n - 1, t, j + n - 1, n))
    return out


def test_matches_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(150):
        sequences = [rng.integers(0, 4, int(rng.integers(1, 12))).tolist() for _ in range(3)]
        text = rng.integers(0, 5, 25).tolist()
        got = list(licenses.Automaton(sequences).matches(text, 2))
        assert len(got) == len(set(got)) and set(got) == maximal(sequences, text, 2)
        assert [x[0] for x in got] == sorted(x[0] for x in got)


def best_chains(matches):
    """Most words that a chain ending with each match covers, over all chains."""
    out = []
    for i, (first, stop, t_first, t_stop) in enumerate(matches):
        best = stop - first
        for (_, end, _, t_end), cover in zip(matches[:i], out, strict=True):
            gain = stop - first - max(0, end - first, t_end - t_first)
            if end >= first - licenses.MOST_GAP and gain > 0:
                best = max(best, cover + gain)
        out.append(best)
    return out


def test_chains_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        template = [int(x) for x in rng.integers(0, 12, 30)]
        text = []
        for w in template * 2:
            if rng.random() < 0.85:
                text.append(w)
            if rng.random() < 0.2:
                text.append(99)
        found = sorted(maximal([template], text, licenses.LEAST_MATCH))
        given = [(end + 1 - n, end + 1, t_end + 1 - n, t_end + 1) for end, _, t_end, n in found]
        chains = licenses.Chains()
        for m in given:
            chains.add(*m)
        want = best_chains(given)
        assert [n[3] for n in chains.nodes] == want
        apart = chains.apart(10)
        assert max((c for *_, c in apart), default=0) == max((c for c in want if c >= 10), default=0)
        assert all(x[1] <= y[0] or y[1] <= x[0] for i, x in enumerate(apart) for y in apart[:i])


def test_stray_words_at_any_joints_lose_no_template():
    parts = [[f"{k}{i}" for i in range(10)] for k in "pqr"]
    joint = ["xx", "yy", "zz"]
    template = [*parts[0], *joint, *parts[1], *joint, *parts[2]]
    scanner = licenses.Scanner([("own", " ".join(template))])
    for pattern in range(16):
        text = []
        for k, piece in enumerate([parts[0], joint, parts[1], joint, parts[2]]):
            text += piece + (["stray"] if k < 4 and pattern >> k & 1 else [])
        assert [s[0] for s in scanner.spans([w.encode() for w in text])] == ["own"], pattern
        assert scanner.spans([w.encode() for w in text])[0][3] == 1.0


def test_long_texts_of_hits_take_linear_time():
    began = time.time()
    scanner = licenses.Scanner()
    words = licenses.words_of("cc by " * 1_000_000)
    assert len(scanner.base(words)[0]) == 1_000_000 and scanner.spans(words) == []
    assert len(scanner.spans(licenses.words_of("released under the mit license " * 100_000))) >= 100_000
    assert time.time() - began < 60


def test_spans_survive_edits():
    s = licenses.Scanner()
    text = "intro words " + licenses.TEMPLATES[0][1].replace("free of charge", "free of any charge").replace("merge", "mergers") + " and more"
    found = s.spans(licenses.words_of(text))
    assert found[0][0] == "mit" and found[0][1] == 2 and found[0][3] > 0.85
    assert [x[0] for x in s.spans(licenses.words_of("x y Licensed under the Apache License, Version 2.0."))] == ["apache-2.0"]
    assert s.spans(licenses.words_of("the of and to in this software is license work under the of")) == []


def test_license_odd_tables(spark):
    docs = spark.createDataFrame([(None, "cc by", "a", 1), (1, "w " * 50_000, None, 2), (1, "w " * 50_000, None, 2)], "doc_id long, text string, labels string, score int")
    assert licenses.scan(docs).count() == 3 and licenses.scan(docs.limit(0)).count() == 0


def test_layout():
    text = lambda x: html_text.extract(x)[1]
    assert text("<p>one<p>two <b>bold</b>  text<div>three</div>four") == "one\n\ntwo bold text\n\nthree\nfour"
    assert text("<ul><li>a<li>b<ol start=4><li>x<li>y</ol><li>c</ul>") == "- a\n- b\n  4. x\n  5. y\n- c"
    assert text("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>after") == "Name       Qty\napple pie  3\n\nafter"
    assert text("<p hidden>a</p><div style='x:y; DISPLAY : none'>b</div><script>if (a<b) '</p>'</script><!-- c --><style>d</style>e") == "e"
    assert text("<pre>  a\n b</pre>c<br>d &amp; &copy; 1 < 2") == "  a\n b\n\nc\nd & © 1 < 2"
    assert text("<title>t</title><body>x<a href='>'>y</a></i></table>z") == "xyz"
    assert html_text.extract("<head><title> A &lt; B </title></head>")[0] == "A < B"
    assert html_text.extract(None) == ("", "", 0, 0) and text("<p>open <b") == "open"
    assert text("<div>" * 5000 + "deep") == "deep"


def test_spanning_cells_stay_aligned():
    text = lambda x: html_text.extract(x)[1]
    assert text("<table><tr><td>a<td colspan=2>wide<td>z<tr><td>bb<td>c<td>d<td>e</table>") == "a   wide  z\nbb  c  d  e"
    assert text("<table><tr><td rowspan=2>tall<td>x<tr><td>y<tr><td>low<td>w</table>") == "tall  x\n      y\nlow   w"
    assert text("<table><tr><td colspan=3>a long heading<tr><td>1<td>2<td>3</table>") == "a long heading\n1  2  3"
    assert text("<table><tr><td colspan=9999999>a<td>b</table>") == "a  b"


def test_visibility_is_undone_by_children():
    text = lambda x: html_text.extract(x)[1]
    assert text("<div style='visibility:hidden'>no <b style='visibility: visible'>yes <i>also</i></b> no</div>end") == "yes also\nend"
    assert text("<div style='display:none'>no <b style='visibility:visible'>no</b></div>end") == "end"
    assert text("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>") == "yes"


def test_blocks_at_any_depth_and_long_pages():
    text = lambda x: html_text.extract(x)[1]
    began = time.time()
    assert text("<div>" * 50_000 + "one<div>two</div>three") == "one\ntwo\nthree"
    deep = text("<ul><li>x" * 3_000)
    assert deep.count("- x") == 3_000 and max(map(len, deep.split("\n"))) <= html_text.MOST_INDENT + 3
    assert text("<table><tr><td>" * 2_000 + "in") == "in"
    assert len(text("<p>word <b>bold</b>" * 200_000)) > 2_000_000
    assert text("</b></i>" * 100_000 + "<b>" * 20_000 + "end") == "end"
    assert time.time() - began < 60


def test_rendering_against_plain_blocks():
    """Random pages of blocks, lists and inline tags against a plain rendering of the same structure."""
    rng = np.random.default_rng(9)
    for _ in range(100):
        source, want, n = [], [], 0
        for _ in range(int(rng.integers(1, 8))):
            kind, words = int(rng.integers(0, 4)), [f"w{n + i}" for i in range(int(rng.integers(1, 5)))]
            n += len(words)
            inline = " ".join(f"<b>{w}</b>" if rng.random() < 0.3 else w for w in words)
            if kind == 0:
                source.append(f"<p>{inline}" + ("</p>" if rng.random() < 0.5 else ""))
                want.append(("p", [" ".join(words)]))
            elif kind == 1:
                source.append("<ul>" + "".join(f"<li>{w}" for w in words) + "</ul>")
                want.append(("p", [f"- {w}" for w in words]))
            elif kind == 2:
                source.append(f"<div>{inline}</div>")
                want.append(("div", [" ".join(words)]))
            else:
                source.append("<ol start=3>" + "".join(f"<li>{w}</li>" for w in words) + "</ol><p style='display:none'>hidden</p>")
                want.append(("p", [f"{i + 3}. {w}" for i, w in enumerate(words)]))
        lines = []
        for i, (kind, block) in enumerate(want):
            if i and "p" in (kind, want[i - 1][0]):
                lines.append("")
            lines += block
        assert html_text.extract("\n".join(source))[1] == "\n".join(lines)


def test_every_visible_word_once(spark):
    rng = np.random.default_rng(5)
    tags = ["div", "p", "b", "ul", "li", "table", "tr", "td", "span", "h2", "blockquote"]
    for _ in range(60):
        words, out = [], []
        for i in range(40):
            k = rng.random()
            tag = tags[int(rng.integers(0, len(tags)))]
            out.append(f"<{tag}>" if k < 0.35 else f"</{tag}>" if k < 0.6 else f" w{i} ")
            if k >= 0.6:
                words.append(f"w{i}")
        assert sorted(re.findall(r"w\d+", html_text.extract("".join(out))[1])) == sorted(words)


def test_html_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x" * 3, 2), (2, "u", "", 3), (2, "u", "", 3)], "page_id long, url string, html string, text int")
    got = html_text.rendered(pages)
    assert got.count() == 4 and html_text.rendered(pages.limit(0)).count() == 0
    assert {r.text for r in got.collect()} == {"", "x\n\nx\n\nx"}


@pytest.mark.parametrize(("page", "n_lines"), [("<p>" + "<b>wordy</b> " * 500_000, 1), ("<br>" * 500_000 + "<div></div>" * 200_000, 1), ("<p>x</p>" + "<br>" * 500_000 + "<div></div>" * 200_000 + "y", 3), ("<pre>" + "a\n" * 500_000 + "</pre>", 500_000)])
def test_pages_cost_their_length(page, n_lines):
    began = time.process_time()
    _, text, _, _ = html_text.extract(page)
    assert time.process_time() - began < 30
    assert abs(text.count("\n") + 1 - n_lines) <= 2
