"""Splitting, site lines, page bodies and residue on small fixtures, against brute force where there is one."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import page_body, residue, site_lines, splitting

CLASH = "k string, t string, d string, s string, line_no string, chunk_id string, doc_id string, text string, source_domain string"


def clash_rows(rows):
    """(chunk_id, doc_id, text, source_domain) with extra columns named like internal ones."""
    return [("k", "t", "d", "s", "n", *r) for r in rows]


# --- splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\té😀", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_pieces_are_within_limit_and_cover(text, limit, overlap):
    t = text.strip()
    spans, level = splitting.pieces_of(t, limit, overlap)
    assert all(0 < e - s <= limit for s, e in spans)
    covered = set()
    for (s, e), nxt in zip(spans, [*spans[1:], None]):
        covered.update(range(s, e))
        if nxt:
            assert s < nxt[0] and e < nxt[1] and nxt[0] >= e - overlap
    assert all(i in covered or t[i].isspace() for i in range(len(t)))
    assert level in ("paragraph", "line", "sentence", "space", "none")


def stretches(t, seps):
    return max((len(x) for x in re.split("|".join(seps), t)), default=0)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc .!?\n", max_size=200))
def test_boundary_is_the_first_level_that_suffices(text):
    t, limit = text.strip(), 12
    if len(t) <= limit:
        return
    levels = [("paragraph", r"\n(?:[^\S\n]*\n)+\s*"), ("line", r"\s*\n\s*"), ("sentence", r"(?<=[.!?])\s+"), ("space", r"\s+")]
    want = next((n for i, (n, _) in enumerate(levels) if stretches(t, [p for _, p in levels[: i + 1]]) <= limit), "none")
    assert splitting.pieces_of(t, limit, 0)[1] == want


def test_split_edges(spark):
    long = "word. " * 900
    rows = clash_rows([("a", "d1", long, None), ("a", "d1", long, None), ("b", "d2", None, "x"), ("c", "d3", " \r\n ", "x"), ("d", None, "short\r\ntext", "x"), (None, "d5", "x" * 4000, "x")])
    df = spark.createDataFrame(rows, CLASH)
    got = splitting.split_oversized(df).collect()
    of = defaultdict(list)
    for r in got:
        of[r.parent_chunk_id].append(r)
    assert len({r.chunk_id for r in of["a"]}) == len(of["a"]) >= 3 and all(len(r.text) <= 1800 for r in got if r.text)
    assert [r.text for r in of["b"]] == [None] and [r.text for r in of["c"]] == [""] and [r.text for r in of["d"]] == ["short\ntext"]
    assert [r.boundary for r in of[None]] == ["none"] * 3
    found = {(r.chunk_id, r.boundary) for r in splitting.oversized_boundaries(df).collect()}
    assert found == {("a", "sentence"), (None, "none")}
    assert splitting.split_oversized(df.where("false")).count() == 0 and splitting.oversized_boundaries(df.where("false")).count() == 0


def test_overlap_starts_at_a_sentence():
    t = " ".join(f"Sentence number {i} has some words in it." for i in range(200))
    spans, _ = splitting.pieces_of(t)
    for (_, e), (s, _) in zip(spans, spans[1:]):
        assert 0 < e - s <= 220 and t[s] == "S" and t[s - 2] == "."


# --- site lines


def brute_lines(rows):
    docs, has = defaultdict(set), defaultdict(set)
    for k, d, t, s in rows:
        if s and t is not None and d is not None:
            s = re.sub(r"^www\.", "", s.lower())
            for n, x in enumerate(t.split("\n")):
                x = re.sub("[0-9]+", "0", re.sub(r"\s+", " ", x.lower()).strip())
                if x:
                    docs[s].add(d)
                    has[s, x].add(d)
    out = set()
    for k, d, t, s in rows:
        if s and t is not None and d is not None:
            s = re.sub(r"^www\.", "", s.lower())
            for n, x in enumerate(t.split("\n")):
                x = re.sub("[0-9]+", "0", re.sub(r"\s+", " ", x.lower()).strip())
                if x and len(has[s, x]) >= 5 and len(has[s, x]) >= 0.05 * len(docs[s]):
                    out.add((k, n))
    return out


def test_repeated_lines_match_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(260):
        lines = [r.choice(["Menu  1", "menu\xa02", "© Us", "Tip", f"unique {chr(97 + i % 26)}{chr(97 + i // 26)}", "", " "]) for _ in range(r.randint(0, 6))]
        rows.append((f"c{i}", f"d{i}", r.choice(["\n", "\r\n"]).join(lines) if i % 17 else None, r.choice(["www.A.x", "a.x", "A.X", "b.x", "c.x", None, ""])))
    rows += rows[:40]  # delivered again
    df = spark.createDataFrame(clash_rows(rows), CLASH)
    got = {(x.chunk_id, x.line_no) for x in site_lines.repeated_lines(df).collect()}
    assert got == brute_lines(rows) and got
    clean = {x.chunk_id: x.clean_text for x in site_lines.without_repeated_lines(df).collect()}
    for k, d, t, s in rows:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in got)
        assert clean[k] == want
    assert site_lines.repeated_lines(df.where("false")).count() == 0


def test_lines_go_by_their_own_text(spark):
    """A key with two texts, and documents without a key, lose only the lines of their own text."""
    rows = [(f"c{i}", f"d{i}", f"legal notice\nbody {chr(97 + i)}", "a.x") for i in range(6)]
    rows += [("kx", "e1", "legal notice\nfirst body", "a.x"), ("kx", "e1", "keep me\nlegal notice", "www.A.x"), (None, "e2", "one\nlegal notice", "a.x"), (None, "e3", "legal notice\ntwo", "a.x"),
             (None, "e4", None, "a.x"), ("far", "e5", "legal notice\nthree", None), ("far", "e5", "legal notice\nthree", "a.x"), ("alone", None, "legal notice", "a.x")]
    got = sorted(((x.chunk_id, x.clean_text) for x in site_lines.without_repeated_lines(spark.createDataFrame(clash_rows(rows), CLASH)).collect()), key=repr)
    want = [(f"c{i}", f"body {chr(97 + i)}") for i in range(6)] + [("kx", "first body"), ("kx", "keep me"), (None, "one"), (None, "two"), (None, None), ("far", "three"), ("alone", "legal notice")]
    assert got == sorted(want, key=repr)


# --- page bodies

PAGES = [
    ("Skip to main content\nHome | About | Contact\nBy the Ostoby policy writers\n\nHow to renew a card\n\nThe clerk must renew the card in the same week. Each card is valid for 4 years.\n\nYou may also like\n* How to sign a form\n* Why the lead should print the note\n\nCookies in the staff portal only hold the session of the clerk.\n\n- Birth extract in colour\n- Bank statement sent by post\n\n© 2020 Us Pty. Licence no. 3\nBack to top", {0, 1, 2, 8, 9, 10, 17, 18}),
    ("We use cookies to measure visits.\nAccept all  Reject optional\nThe applicant keeps the receipt because the scheme covers only paid roles.\nWas this page helpful? Yes / No", {0, 1, 3}),
]


def test_page_body(spark, data):
    chunks = spark.read.parquet(f"{data}/au_blog_chunks.parquet")
    model = page_body.fit(chunks)
    rows = clash_rows([(f"p{i}", "d", t, "x") for i, (t, _) in enumerate(PAGES)] * 2 + [("null", "d", None, "x"), ("blank", "d", " \n\n", "x"), ("long", "d", "The clerk must sign the note. " * 9000, "x")])
    df = spark.createDataFrame(rows, CLASH)
    got = defaultdict(set)
    for r in page_body.furniture_lines(df, model=model).collect():
        assert r.line_no not in got[r.chunk_id]
        got[r.chunk_id].add(r.line_no)
    for i, (_, want) in enumerate(PAGES):
        assert got[f"p{i}"] == want
    assert not got["null"] and not got["blank"] and not got["long"]
    body = {r.chunk_id: r.body for r in page_body.main_body(df, model=model).collect()}
    assert body["null"] is None and body["blank"].strip() == "" and "only hold the session" in body["p0"] and "Accept all" not in body["p1"]
    assert page_body.furniture_lines(df.where("false"), model=model).count() == 0
    assert page_body.furniture_lines(df.where("false")).count() == 0  # nothing to train on either


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    model = page_body.train([t for t, _ in PAGES])
    lines = page_body.lines_of("Home\nThe clerk must sign.\n\n- Extract in colour\n- Note\nBack to top")
    k, n = len(page_body.KINDS), len(lines)
    node = np.array([model.weights[x.slots].sum(0) + model.bias for x in lines])
    total = np.zeros((n, k))
    for states in itertools.product(range(k), repeat=n):
        s = sum(node[i, y] for i, y in enumerate(states))
        for i, (p, e) in enumerate(page_body.parents_of(lines)):
            s += model.first[states[i]] if p < 0 else model.edges[e, states[p], states[i]]
        for i, y in enumerate(states):
            total[i, y] += np.exp(s)
    assert np.allclose(page_body.marginals(model, [lines])[0], total / total.sum(1, keepdims=True), atol=1e-5)


def test_held_out_accuracy(spark, data):
    """Lines of pages that took no part in training, against the seed rules where these are sure."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/au_blog_chunks.parquet").select("text").distinct().collect() if r.text]
    model = page_body.train(texts[: len(texts) // 2])
    pages = [page_body.lines_of(t) for t in texts[len(texts) // 2 :]]
    same = total = 0
    for lines, m in zip(pages, page_body.marginals(model, pages)):
        for seed, row in zip(page_body.seed_labels(lines), m):
            if seed is None:  # the rules are not sure
                continue
            total += 1
            same += (row[0] < 0.5) == (seed != 0)
    assert same / total > 0.98


def test_lines_without_any_cue(spark):
    """Held-out lines whose cues are hidden in training and from the model: wording, shape and place tell most, the tree tells more."""
    texts = sorted({r.text for r in spark.read.parquet("/root/testdata/sf0.01/au_blog_chunks.parquet").select("text").collect() if r.text})
    model = page_body.train(texts[::2], cues=False)
    flat = page_body.Model(model.weights, model.bias, model.edges * 0, model.first * 0, False)  # nodes only
    pages = [page_body.lines_of(t) for t in texts[1::2]]
    seeds = [page_body.seed_labels(p) for p in pages]

    def accuracy(m):
        same = [(r[0] < 0.5) == (s != 0) for ls, rows in zip(seeds, m) for s, r in zip(ls, rows) if s is not None]
        return sum(same) / len(same)

    most = accuracy([[(1.0,)] * len(p) for p in pages])  # rules alone, without their lists: all main body
    nodes, tree = accuracy(page_body.marginals(flat, pages)), accuracy(page_body.marginals(model, pages))
    assert most < 0.7 and nodes > 0.9 and tree > nodes and tree > 0.95, (most, nodes, tree)


def test_seed_rules_abstain():
    lines = page_body.lines_of("Home | About | Contact\n› How to sign a form\n\nShare | Print | Save\nBefore you begin\nHome | Pricing\nThe clerk must sign the card.\n- Bank statement\n› Read on")
    assert page_body.seed_labels(lines) == [page_body.MENU, None, page_body.EDGE, None, page_body.MENU, page_body.MAIN, page_body.MAIN, None]


def test_bodies_of_one_record(spark):
    """Deliveries with the same text come once, other texts of a key and rows without a key stay apart."""
    model = page_body.train([t for t, _ in PAGES])
    rows = clash_rows([("a", "d", "The clerk must sign the card.", "x")] * 3 + [("a", "d", "The lead must print the note.", "x"), (None, "d", "The clerk must sign the card.", "x"), (None, "d", "The clerk must print the card.", "x"), (None, "d", None, "x"), ("a", "d", None, "x")])
    got = sorted(((r.chunk_id, r.body) for r in page_body.main_body(spark.createDataFrame(rows, CLASH), model=model).collect()), key=repr)
    assert got == sorted([("a", "The clerk must sign the card."), ("a", "The lead must print the note."), (None, "The clerk must sign the card."), (None, "The clerk must print the card."), (None, None), ("a", None)], key=repr)


# --- residue

CASES = [
    ("Dear {{first_name}}, your form was signed.", True), ("Hello [your candidate]! Please sign.", True), ("Signed on %WORK_SITE%.", True), ("It costs [object Object].", True),
    ("Lorem ipsum dolor sit amet consectetur elit.", True), ("Coming soon.", True), ("Sorry, the page you asked for cannot be found.", True), ("Please enable JavaScript to view this page.", True),
    ("Trang bạn tìm không tồn tại hoặc đã bị gỡ.", True), ("Error 404: la página solicitada no existe.", True), ("The form was signed.\n\nTraceback (most recent call last):\n  File \"a.py\", line 3", True),
    ("asdf asdf asdf zzz", True), ("HTTP 504 - gateway time-out.", True), ("Your (TBC: state) is due.", True), ("Page text to be supplied by the content owner.", True),
    ("The template keeps a merge field named '{{start_date}}', which the system fills in before sending.", False), ("Staff saw 'access denied' when the fee receipt was compared twice.", False),
    ("The old form returned a 503 message during maintenance, so 4 cases were uploaded by hand.", False), ("Auditors searched all pages for sample text such as 'lorem ipsum' and found none in 2018.", False),
    ("Allow scripts in the browser before the identity step, or the camera of the security firm will not start.", False), ("See the fee [see note 3] and keep the bracket [sic] of the old slip.", False),
    ("[ ] Sign the form\n[x] Print the note", False), ("```\nHello {{name}}\n```\nThe clerk keeps the note.", False), ("No appeal file is corrected if the referee cannot be reached.", False),
    ("Under construction sites, a clerk must check the note.", False), ("When the overseas record is withdrawn for Ostoby sites", False), ("The clerk keeps the note and zzz asdf asdf asdf test asdf asdf", True), ("Type something about your team.", True),
    ("", False), ("   \n", False), (None, False),
    ("In Jinja you write {{ name }} to print a value.", False), ("Templates are short.\n\n    {{ user.name }}\n\nThe clerk keeps them.", False), ("Set ${HOME} before you run the script.", False),
    ("<?php echo 1; ?> prints one.", False), ("Use [Name] tags in Markdown.", False), ("The 404 error page says the page was not found.", False), ("Keep `{{id}}` as it is.", False),
    ("Mustache is a template language. Each value is named once.\nWrite {{name}} where it goes.\nMustache leaves the rest.", False), ("Dear <?php echo $name; ?>, your form was signed.", True), ("The clerk in ${OFFICE} must print the note.", True),
    ("JavaScript is required and must be enabled in the settings of your browser before you can view this page or use any of the services on this site, so please turn it on now and then reload the page and try again", True),
    ("Para ver esta página y usar los servicios de este sitio active JavaScript en su navegador y después vuelva a cargar la página, por favor, o inténtelo de nuevo más tarde con otro navegador", True),
]


@pytest.mark.parametrize("text,is_case", CASES)
def test_residue(text, is_case):
    assert (residue.residue_of(text) is not None) == is_case


def test_residue_operator(spark):
    rows = [(i, t, "x", "y") for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0], "x", "y"), (None, "Coming soon.", None, None), (99, "The clerk signs the note. " * 20000 + "{{name}}", "", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string, family string")
    got = sorted((r.doc_id for r in residue.residue_found(df).collect()), key=lambda x: (x is None, x))
    assert got == [i for i, (_, c) in enumerate(CASES) if c] + [99, None]
    kept = residue.without_residue(df).collect()
    assert {r.doc_id for r in kept} == {i for i, (_, c) in enumerate(CASES) if not c}
    assert residue.residue_found(df.where("false")).count() == 0
