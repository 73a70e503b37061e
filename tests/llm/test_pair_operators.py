"""Near-duplicates, broken pairs, tokens and mixes on small fixtures, against brute force where there is one."""

import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import mixing, neardup, pairs, tokenizer

PATH = f"{tokenizer.TOKENIZERS}/{tokenizer.VOCABULARY}"

# --- near-duplicates


def test_golay_code():
    table = neardup.decoding_table()
    assert len(table) == 2048 and Counter(len(v) for v in table.values()) == {1: 277, 6: 1771}
    r = random.Random(1)
    for _ in range(400):
        v = r.getrandbits(23)
        w = v ^ sum(1 << i for i in r.sample(range(23), r.randint(0, 2)))
        assert neardup.codewords_near(v, table) & neardup.codewords_near(w, table)  # up to two errors always share a key
        assert all(neardup.syndrome(v ^ e) == 0 for e in table[neardup.syndrome(v)])


def edited(words, r, share):
    out = [r.choice(VOC) if r.random() < share else w for w in words]
    if r.random() < 0.3:
        i = r.randrange(len(out))
        out = out[i:] + out[:i]
    return out


VOC = [f"w{i}" for i in range(700)]


def fixture():
    r = random.Random(5)
    rows = []
    for i in range(60):
        base = [r.choice(VOC) for _ in range(r.randint(35, 160))]
        rows.append((f"a{i}", " ".join(base)))
        for j in range(r.randint(0, 3)):
            rows.append((f"b{i}_{j}", " ".join(edited(base, r, r.choice([0, 0.01, 0.03, 0.06, 0.1])))))
    rows += [("copy1", rows[0][1].upper()), ("copy2", rows[0][1] + "!"), rows[3], (None, "x"), ("null", None), ("blank", " \n"), ("long", " ".join(r.choice(VOC) for _ in range(60_000)))]
    return rows


def brute(rows, threshold=0.6):
    texts = {}
    for k, t in rows:
        if k is not None and t is not None and len(neardup.words_of(t)) >= 40:
            texts.setdefault(k, set()).add(t)
    return {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if any(neardup.jaccard(x, y) >= threshold for x in texts[a] for y in texts[b])}


def test_similar_pairs_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(k, t, 1, "c", "a") for k, t in rows], "id string, content string, key int, cls string, a string")
    recs = neardup.records_of((df, "id", "content"))
    want = brute(rows)
    got = {(r.a, r.b) for r in neardup.similar_pairs(recs).collect()}
    assert len(want) > 40 and not got - want and len(got & want) >= 0.99 * len(want)
    groups = {r.chunk_id: r for r in neardup.similar_groups(recs).collect()}
    for a, b in got:
        assert groups[a].group_id == groups[b].group_id
    assert groups["copy1"].copies >= 3 and set(groups) == {x for p in got for x in p}
    assert neardup.similar_pairs(recs.where("false")).count() == 0 and neardup.similar_groups(recs.where("false")).count() == 0


def test_large_groups_split_by_codewords_give_the_same_pairs(spark, monkeypatch):
    recs = neardup.records_of((spark.createDataFrame([r[:2] for r in fixture()], "id string, content string"), "id", "content"))
    whole = {(r.a, r.b) for r in neardup.similar_pairs(recs).collect()}
    monkeypatch.setattr(neardup, "MANY", 1)
    assert {(r.a, r.b) for r in neardup.similar_pairs(recs).collect()} == whole and len(whole) > 40


def test_recall_at_the_threshold():
    """Pairs right above a similarity of 0.6 with a word overlap of about 0.7: at least 99.5 % share a key."""
    r, table, pairs_ = random.Random(4), neardup.decoding_table(), []
    new = lambda: f"w{r.randrange(10**6)}"
    while len(pairs_) < 400:
        a = [new() for _ in range(200)]
        b = a + [new() for _ in range(70)]
        while neardup.jaccard(" ".join(a), " ".join(b)) >= 0.6:
            last, at = b, r.randrange(2, 198)
            b = b[:at] + [new()] + b[at:]
        pairs_.append((" ".join(a), " ".join(last)))
    f = neardup.Fingerprints(neardup.SEGMENTS, neardup.EXACT, neardup.SHINGLE, neardup.LEAST_WORDS)
    (_, _, x, p, _), (_, _, y, q, _) = (f.of([pair[side] for pair in pairs_]) for side in (0, 1))
    near = lambda i, j: neardup.codewords_near(int(i), table) & neardup.codewords_near(int(j), table)
    met = sum(any(p[n, k] == q[n, k] and near(x[n, k], y[n, k]) for k in range(neardup.SEGMENTS)) for n in range(len(pairs_)))
    assert met >= 0.995 * len(pairs_), met


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.group for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


# --- tokens


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encode_equals_reference(reference, text):
    t = tokenizer.transducer(PATH)
    assert t.encode(text) == reference.encode_ordinary(text)
    assert t.decode(t.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40))
def test_streamed_utf8(data, cut):
    assert "".join(tokenizer.Utf8Stream().feed_all([data[:cut], data[cut:]])) == data.decode("utf-8", "replace")


def test_token_operator(spark, reference):
    texts = ["a" * 20_000, "the " * 8000, "", None, " \n\t ", "<|endoftext|> x", "é😀ạ", "don't 12345"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, ids string, _text string")
    got = tokenizer.with_tokens(df, keep=["doc_id"]).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r.ids == (reference.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
    back = tokenizer.with_text(tokenizer.with_tokens(df, keep=["doc_id"]), keep=["doc_id"]).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    assert tokenizer.with_tokens(df.where("false"), keep=["doc_id"]).count() == 0


# --- mixing


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, "word " * r.randint(1, 60), ["A-One ", "a_one", "b", "C", None, "other"][i % 6], 1) for i in range(600)]
    rows += [(9000, None, "b", 1), (9001, "", "b", 1), (None, "word", "b", 1)] + rows[:10]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int")
    targets = spark.createDataFrame([("a_one", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 9), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs)
    mixed = mixing.mix(docs, targets, sizes=sizes)
    got = mixed.collect()
    assert [x.position for x in got] == list(range(1, len(got) + 1))
    assert len({(x.doc_id, x.copy, x.source, x.n_tokens) for x in got}) == len(got)
    repeats = {"a_one": 1, "b": 3, "c": 9}
    assert all(x.copy < repeats[x.source] for x in got)
    report = {x.source: x for x in mixing.shares(mixed, targets, sizes).collect()}
    for s, w in (("a_one", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(report[s].share - w / 0.95) < 0.02
    assert report["none"].share == 0
    # every prefix of the mix keeps the shares, within a document for each source
    total, of = 0, Counter()
    for x in got:
        total += x.n_tokens
        of[x.source] += x.n_tokens
        for s, w in (("a_one", 0.5), ("b", 0.3), ("c", 0.15)):
            assert abs(of[s] - total * w / 0.95) <= 3 * 61
    small = mixing.mix(docs, targets, sizes=sizes, budget=500).collect()
    assert [(x.doc_id, x.copy) for x in small] == [(x.doc_id, x.copy) for x in got[: len(small)]] and 400 < sum(x.n_tokens for x in small) <= 500
    large = mixing.mix(docs, targets, sizes=sizes, budget=10**9).collect()
    assert Counter(x.source for x in large) == {"a_one": 200 - 0, "b": 3 * len({i for i in range(600) if i % 6 == 2}) + 3, "c": 9 * 100}
    assert mixing.mix(docs.where("false"), targets).count() == 0 and mixing.mix(docs, targets.where("false"), sizes=sizes).count() == 0


def test_mix_with_a_large_share_missing(spark):
    """Shares of sources without documents go to the others, and the source that limits the mix gives all its repeats."""
    docs = spark.createDataFrame([(i, "word " * 9, "a" if i < 20 else "b") for i in range(420)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 5), ("b", 0.3, 5), ("none", 0.4, 5)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs)
    got = {x.source: x for x in mixing.shares(mixing.mix(docs, targets, sizes=sizes), targets, sizes).collect()}
    assert got["a"].mixed_records == got["b"].mixed_records == 100 and got["a"].most_repeats == 5 and got["none"].mixed_records == 0


def test_mix_reaches_shares_when_most_of_the_target_is_missing(spark):
    docs = spark.createDataFrame([(i, "word " * 9, "a" if i < 10 else "b") for i in range(210)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.2, 5), ("b", 0.2, 5), ("none", 0.6, 5)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs)
    got = {x.source: x for x in mixing.shares(mixing.mix(docs, targets, sizes=sizes), targets, sizes).collect()}
    assert got["a"].most_repeats == 5 and abs(got["a"].share - 0.5) < 0.02 and abs(got["b"].share - 0.5) < 0.02


def test_texts_of_equal_length_count_each(spark):
    """Documents of one key and source whose different texts have equally many tokens are different documents."""
    docs = spark.createDataFrame([(1, "one two", "a"), (1, "two one", "a"), (1, "one two", "A "), (2, "one two", "a")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert [x.doc_id for x in mixing.mix(docs, targets).orderBy("doc_id").collect()] == [1, 1, 2]


# --- broken pairs

PAIRS = [
    ("Make it shorter", None, "empty"), ("Make it shorter", " ​", "empty"), ("Make it shorter", "<p></p>", "empty"), ("Make it shorter", "N/A", "empty"), ("Yes or no: may I?", "No", None), ("When?", "Only with consent", None),
    ("Explain why the card is signed", "user_prompt: Explain why the card is signed", "copies_question"), ("Them 67 y ve lich su dia chi", "Sorry, no draft can be offered for this topic.", "refusal"),
    ("Explain why the card is signed", "> Explain why the card is signed", "copies_question"), ("Explain why the card is signed", "Explain why the card is signed\nExplain why the card is signed", "copies_question"),
    ("Explain why the card is signed", "> Explain why the card is signed\n\nThe clerk signs the card because the scheme needs it.", None),
    ("List five cards", "I'm sorry, but I cannot help with that. Let me know if you have another question.", "refusal"), ("Write a guide", "I can't stress this enough: start early. The clerk must sign the card in the same week. Each card is valid for two years and the lead must print the note.", None),
    ("Draft an email declining the clerk", "Dear clerk,\n\nWe are sorry, but we cannot offer you the role. The card was signed at the end of the month.\n\nKind regards,\nUs Trust", None),
    ("Viết lại phần về thẻ", "Tôi xin phép từ chối yêu cầu này.", "refusal"), ("What should the clerk do when the worker moves?", "La empresa no debe renovar la carta de referencia si la foto está borrosa.", "other_language"),
    ("Translate into Spanish: the clerk must sign the card", "La empresa debe firmar la tarjeta de trabajo.", None), ("Viet lai phan ve the lam viec", "Bộ phận nhân sự cần nộp thẻ làm việc khi có kết quả.", None),
    ("Write a guide for the clerk", "The clerk must sign the card in the same week. When the worker moves, the audit te", "truncated"), ("Write a guide for the clerk", "# Cards\n\nThe clerk must sign the card.\n\n## Notes for the lead\n\n", "truncated"),
    ("Give me a table for the clerk", "| Card | 3 | Ostoby |\n|---|---|---|\n| Note | 4 | Ostoby |", None), ("Give me a table for the clerk", "| Card | 3 | Ostoby |\n|---|---|---|\n| Note | 4", "truncated"),
    ("Give me a list for the clerk", "- Sign the card in colour\n- Print the note in colour\n- Scan the card because", "truncated"), ("Give me a list for the clerk", "- Sign the card in colour\n- Print the note in colour\n- Scan the card in colour", None),
    ("Give me JSON for the clerk", '["Sign the card", "Print the', "truncated"), ("Give me JSON for the clerk", '["Sign the card", "Print the note"]', None),
]


def test_broken_pairs(spark):
    rows = [("chat", f"s{i}", 0, p, a, "x", "y") for i, (p, a, _) in enumerate(PAIRS)]
    rows += [rows[0], ("chat", "nullprompt", 0, None, "The clerk must sign the card.", "x", "y"), ("chat", "long", 0, "Write", "The clerk must sign the card. " * 4000, "x", "y")]
    df = spark.createDataFrame(rows, "origin string, record_id string, turn_no int, prompt string, answer string, defect string, word string")
    got = [(r.record_id, r.defect) for r in pairs.broken_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert dict(got) == {f"s{i}": d for i, (_, _, d) in enumerate(PAIRS) if d}
    assert pairs.broken_pairs(df.where("false")).count() == 0


def test_refusal_templates_come_from_recurrence(spark):
    """An opening that declines in words of its own counts where most of its cluster declines in known words."""
    known = [("chat", f"k{i}", 0, p, "Regrettably I cannot help with this particular request today.") for i, p in enumerate(["Write a blog", "Explain the card", "List ten notes", "Draft an email", "Compare two cards"])]
    odd = [("chat", "odd", 0, "Summarise the rules", "Regrettably I cnnot help with this particular request today.")]
    df = spark.createDataFrame(known + odd, "origin string, record_id string, turn_no int, prompt string, answer string")
    assert {(r.record_id, r.defect) for r in pairs.broken_pairs(df).collect()} == {(r[1], "refusal") for r in known + odd}


def test_refusals_read_whole_prompts_and_answers(spark):
    """Prompts of one beginning are several, and neither late content nor the end of a long opening is left out."""
    known = [("chat", f"k{i}", 0, f"Give me a checklist for the {w}", "Regrettably I cannot help with this particular request today.") for i, w in enumerate(["card", "clerk", "note", "permit"])]
    odd = [("chat", "odd", 0, "Give me a checklist for the rules", "Regrettably I cnnot help with this particular request today.")]
    late = " ".join(["I cannot help with this request.", *["Please contact the office."] * 45, *["The clerk must sign the card in the same week and print the note in colour."] * 4])
    df = spark.createDataFrame([*known, *odd, ("chat", "late", 0, "Write a guide", late)], "origin string, record_id string, turn_no int, prompt string, answer string")
    assert {(r.record_id, r.defect) for r in pairs.broken_pairs(df).collect()} == {(r[1], "refusal") for r in known + odd}
    assert pairs.opening("word " * 200 + "end.")[1].endswith("word end")


def test_all_similar_openings_are_linked(spark):
    """Every pair of brute force, also those unlike the least opening of whatever they have in common."""
    r = random.Random(3)
    words = ["i", "cannot", "help", "with", "this"] + [f"w{i}" for i in range(40)]
    stems = [[r.choice(words) for _ in range(r.randint(3, 14))] for _ in range(40)]
    opens = sorted({" ".join(w if r.random() > 0.15 else r.choice(words) for w in s) for s in stems for _ in range(12)} | {"i", "i i", "no"})
    got = [(x.a, x.b) for x in pairs.alike(spark.createDataFrame(list(enumerate(opens)), "id bigint, open string")).collect()]
    sets = [pairs._shingles(o) for o in opens]
    want = {(i, j) for j in range(len(opens)) for i in range(j) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    assert len(want) > 200 and len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want


def test_pairs_of_tables(spark):
    rows = [("s", [("p", None, None, None, None), None]), ("n", None), (None, [("p", "", None, None, None)])]
    df = spark.createDataFrame(rows, "session_id string, turns array<struct<user_prompt:string,assistant_output:string,parsed_intent:string,parsed_topic:string,generated_draft:string>>")
    assert {(r.record_id, r.turn_no) for r in pairs.chat_pairs(df).collect()} == {("s", 0), (None, 0)}
