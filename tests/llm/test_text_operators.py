"""Page text, perspectives, quality, personal data, fingerprints and partial matching on small tables."""

import hashlib
import random
import re
from html.parser import HTMLParser

import brute_matching
import brute_personal
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import chat, order_minhash, page_text, partial_matching, personal_data, quality

PAGE = """<title>x</title>Hi<p>a <b>b</b>  c<p>next<ul><li>one<li>two<ul><li>in</ul><li>three</ul><ol start=3><li>x<li>y</ol>
<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td rowspan=2>two<br>lines<td>44444<tr><td>z</table>
<pre>
 a
   b</pre><div hidden>no</div><div style="display: none">no</div><span style="visibility:hidden">no<i style="visibility:visible">yes</i></span>
<details><summary>sum</summary>closed</details><blockquote>q1<br>q2</blockquote>&lt;x&gt; 1 < 2 <a href="x>y">link</a><!-- c --> end"""
LAID_OUT = """Hi

a b c

next

- one
- two
  - in
- three

3. x
4. y

Cap
Name       Qty
apple pie  3
two        44444
lines
           z

 a
   b

yes
sum

    q1
    q2

<x> 1 < 2 link end"""


def test_layout_of_a_page():
    assert page_text.page_text(PAGE) == LAID_OUT


@pytest.mark.parametrize(
    "page, text",
    [("", ""), ("<", "<"), ("<a", ""), ('<a href="x', ""), ("<!--x", ""), ("<div>" * 5000 + "x", "x"), ("<table>" * 300 + "x", "x"),
     ("<table><tr><td>" * 60 + "deep", "deep"), ("</p></div>text", "text"), ("<script>x", ""), ("a<br><br>b", "a\n\nb"),
     ("a&nbsp;b", "a b"), ("<p>" * 3 + "y", "y"), ("<select><option>a</select>b", "a\nb")],
)
def test_odd_pages(page, text):
    assert page_text.page_text(page) == text


class Words(HTMLParser):
    """Words in order, without the elements that the given pages hide."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("title", "style", "script")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("title", "style", "script")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_pages_keep_all_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in page_text.page_texts(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        parser = Words()
        parser.feed(r.html)
        assert [w for w in got[r.page_id].split() if w != "-"] == [w for w in parser.words if w != "-"]
    odd = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in page_text.page_texts(odd).collect()) == [("1", ""), ("1", ""), ("None", "x")]


def test_perspectives(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "ann", "again"), (1, None, None, "first"),
             (2, 0, "system", "alone"), (None, 1, "cy", "no id"), (None, 1, "cy", "no id")]
    rows = [(*t, "x") for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(4)
    got = chat.perspectives(df).collect()
    assert len(got) == 5 * 2 + 2 and {(r.conv_id, r.speaker) for r in got} == {(1, "ann"), (1, "bob"), (None, "cy")}
    ann = sorted((r for r in got if r.conv_id == 1 and r.speaker == "ann"), key=lambda r: r.position)
    whole = "".join(r.segment for r in ann)
    assert whole == (
        "<|user|>\nfirst<|end|>\n<|system|>\nBe kind.<|end|>\n<|assistant|>\nhi < |end|><|end|>\n"
        "<|assistant|>\nagain<|end|>\n<|user name=bob|>\n<|end|>\n"
    )
    for r in ann:
        assert whole[r.start : r.end] == r.segment
    masked = [whole[r.mask_start : r.mask_end] for r in ann if r.mask_start is not None]
    assert masked == ["hi < |end|><|end|>", "again<|end|>"]
    assert chat.perspectives(df.limit(0)).count() == 0


def plain_quality(rows, limit, percent, left):
    lines, hosts, out = {}, {}, {}
    for doc_id, host, text in rows:
        hosts.setdefault(host, set()).add(text or "")
        for line in {" ".join(x.lower().split()) for x in (text or "").split("\n")} - {""}:
            lines.setdefault((host, line), {}).setdefault(text or "", set()).add(doc_id)
    for doc_id, host, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
        real = [x for x in text.split("\n") if x.split()]
        gone = 0
        for x in real:
            key = host, " ".join(x.lower().split())
            n = len(lines[key])
            first = min(i for ids in lines[key].values() for i in ids)
            if n > limit and n * 100 > len(hosts[host]) * percent and doc_id != first:
                gone += len(x.split())
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out[doc_id] = (len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), len(real) - len(set(real)), len(covered),
                       failed, not failed and (len(words) - gone) * 100 >= left * len(words))
    return out


def test_quality_rules(spark):
    draw = random.Random(7)
    lines = [" ".join(draw.choice("ab cd ef gh ij kl mn op".split()) + str(draw.randrange(90)) for _ in range(12)) for _ in range(60)]
    common = " ".join(f"licence{i}" for i in range(40))
    rows = []
    for i in range(60):
        own = [draw.choice(lines) for _ in range(draw.randrange(0, 8))]
        text = "\n".join(([common] if i % 2 else []) + own + (["x y z " * 30] if i % 11 == 0 else []))
        rows.append((i, f"h{i % 3}" if i % 10 else None, text))
    rows += [(60, "h1", None), (61, "h1", ""), (62, "h1", "a|b # c\r\nA|b # c\n\n"), (63, "h1", rows[5][2])]
    df = spark.createDataFrame([(*r, "q", 3) for r in rows], "doc_id long, source string, text string, host string, kept int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
           for r in quality.quality(df, 3, 5, 60).collect()}
    want = plain_quality(rows, 3, 5, 60)
    assert got == want and {k[-2:] for k in want.values()} >= {(True, False), (False, True), (False, False)}
    kept = quality.keep_good(df, limit_documents=3, limit_percent=5, left_percent=60)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in want.items() if v[-1])
    assert quality.quality(df.limit(0)).count() == 0


def personal_texts():
    draw = random.Random(8)
    parts = ["mail a.b@c-d.org ", "x@y", "@", "a@b.c@d.e.f ", "1.2.3.4 ", "1.2.3.4444.5.6.7 ", "255.256.1.1 ", "0001.2.3.4 ", "4041894974608795", " ", "-",
             "+1 (988) 555-2485", "+49 30 1234567 ", "+1+2+3 ", "12 34 ", "4111 1111 1111 1111 ", "4111-1111-1111-1112", "é", "漢", "99999999999999999999 ", "555", "."]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(400)]
    return [*texts, None, "", "9" * 5000, "1 2 " * 3000, "a." * 5000 + "@", "+" + "1 " * 3000]


def test_personal_data(spark):
    rows = list(enumerate(personal_texts()))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows] + [(None, "a@b.c", "c")], "doc_id long, text string, base string").repartition(3)
    got = {r.doc_id: r for r in personal_data.personal_spans(df).withColumn("w", personal_data.written(F.col("base"))).collect()}
    for i, text in rows:
        assert got[i].w == brute_personal.written(brute_personal.base(text)), text
        spans = sorted([(s.s, s.e) for s in got[i].added])
        for (s, e), (s2, _) in zip(spans, spans[1:], strict=False):
            assert e <= s2
        for s, e in spans:
            assert 0 <= s < e <= len(text) and not any(b.s < e and s < b.e for b in got[i].base)
    clean = {r.doc_id: r.text for r in personal_data.redact(df).collect()}
    assert personal_data.redact(df).columns == df.columns
    assert clean[None] == "[EMAIL]" and [clean[i] for i, t in rows if not t] == [t for _, t in rows if not t]
    for i, text in rows:
        if text and not got[i].added:
            out, at = "", 0
            for s, k, e in brute_personal.base(text):
                if s >= at:
                    out += text[at:s] + f"[{personal_data.KINDS[k].upper()}]"
                at = max(at, e)
            assert clean[i] == out + text[at:]
    assert personal_data.personal_spans(df.limit(0)).count() == 0


def test_trees_add_what_the_patterns_miss(spark):
    """A card that follows a phone is one run of digits for the base; held out, such spans are found and other numbers left alone."""
    draw = random.Random(9)

    def card():
        digits = [4, *(draw.randrange(10) for _ in range(14))]
        total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        return "".join(map(str, digits)) + str(-total % 10)

    rows, planted = [], {}
    for i in range(400):
        phone = f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)}"
        words = "some words before it"
        text = {0: f"{words} {card()} and", 1: f"{words} {phone} and", 2: f"{words} version 12.{i} and 2024-01-{i % 28 + 1:02d} and", 3: words}[i % 4]
        if i % 40 == 0:
            text = f"{words} {phone} {card()} and"
            planted[i] = 2
        rows.append((i, text))
    got = {r.doc_id: r for r in personal_data.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i].base) + len(got[i].added) == n for i, n in planted.items())
    assert not any(got[i].added for i, _ in rows if i not in planted)


def plain_print(text, sketches=order_minhash.SKETCHES):
    """The fingerprint by its definition, with Spark's hash."""
    def h64(*values):
        seed = 42
        for v in values:
            if v is not None:
                data = v.encode() if isinstance(v, str) else v.to_bytes(4, "little") if isinstance(v, bool) else (v % (1 << 64)).to_bytes(8, "little")
                seed = xxhash.xxh64_intdigest(data, seed)
        return seed

    units = re.findall(order_minhash.UNIT, text)
    pairs = [(units[i] if units else None, units[i + 1] if i + 1 < len(units) else None) for i in range(max(1, len(units) - 1))]
    seen, kmers = {}, []
    for place, pair in enumerate(pairs):
        h = h64(*pair)
        n = seen[h] = seen.get(h, -1) + 1
        kmers.append((xxhash.xxh64_intdigest(n.to_bytes(4, "little"), h64(h)), place))
    out = ""
    for j in range(sketches):
        seed = order_minhash._seed(j) % (1 << 64)
        best = [None, None]
        for h, place in kmers:
            side = 0 if h >> (j % 28) & 1 else 1
            value = (((h ^ seed) >> 28) << 27) | place
            best[side] = value if best[side] is None else min(best[side], value)
        a, b = best
        first = True if None in best else a % (1 << 27) < b % (1 << 27)
        out += f"{h64(first, *(None if v is None else v >> 27 for v in best)) >> 32:08x}"
    return out


def test_order_minhash(spark):
    draw = random.Random(10)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 120))) for _ in range(30)]
    texts += [None, "", " ", "one", "sameäword" * 30, "a b " * 400, texts[3], "漢字" * 50]
    rows = [(3 * i, t, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5], (None, "no id at all", "c")], "doc_id long, text string, of string").repartition(3)
    got = order_minhash.edited_likeness(df).collect()
    assert len(got) == len(rows) + 2
    by = {r.doc_id: r for r in got}
    for i, (doc_id, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = by[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(text), plain_print(edited))
        split = [re.findall("........", f) for f in (r.fingerprint, r.edited_fingerprint, plain_print(after))]
        assert r.near_edited == sum(a == b for a, b in zip(split[0], split[1], strict=True)) / 32
        assert r.near_next == sum(a == b for a, b in zip(split[0], split[2], strict=True)) / 32
    assert by[9].fingerprint == by[3 * texts.index(texts[3], 4)].fingerprint and by[None].near_next is None
    assert order_minhash.edited_likeness(df.limit(0)).count() == 0


@pytest.mark.parametrize("frequent, most_grams", [(20, partial_matching.MOST_GRAMS), (0, 0)])
def test_partial_matching(spark, monkeypatch, frequent, most_grams):
    monkeypatch.setattr(partial_matching, "BLOCK_BYTES", 700)
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 7))) for _ in range(80)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 40))) for _ in range(60)] + [None, "", "ABC abc\x0bABC", "z" * 3000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(None, "ab ab", 5), (2, texts[2], 5)], "doc_id long, text string, row int").repartition(3)
    plain = brute_matching.Plain([*rows, (None, "ab ab"), rows[2]], partial_matching.ORDER)
    got = partial_matching.score_documents(df, frequent=frequent, most_grams=most_grams).collect()
    assert len(got) == len(rows) + 2
    texts_of = dict(rows) | {None: "ab ab"}
    for r in got:
        want = plain.document(r.doc_id, texts_of[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3]) and r.score == pytest.approx(want[4])


def test_partial_matching_knows_the_order_of_words(spark):
    """Held-out copies of training passages cost less than the same words in reverse order and less than fresh words."""
    draw = random.Random(5)
    passages = [" ".join("".join(draw.choice("aeioknrst") for _ in range(4)) for _ in range(30)) for _ in range(20)]
    held = [i for i in range(400) if partial_matching.held_out(i)]
    train = [i for i in range(400) if not partial_matching.held_out(i)]
    rows = [*zip(train, passages), *zip(held, passages), *zip(held[20:], (" ".join(p.split()[::-1]) for p in passages))]
    got = {r.doc_id: r.score for r in partial_matching.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[held[i]] > 0.8 * got[held[20 + i]] for i in range(20))
    assert partial_matching.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("window", [1, 3, 7, 1000])
def test_windows_of_signs(window):
    """Windows of any length give the grams of the whole texts."""
    texts = [b"", b"ab  CD\te", b"x" * 40, b" ", b"one two three"]
    parts = list(partial_matching.windows(texts, 6, window))
    got = [(int(t), int(g)) for text, gram in parts for t, g in zip(text, gram, strict=True)]
    want = []
    for number, text in enumerate(texts):
        signs = [partial_matching.WORD_END]
        for word in text.lower().split():
            signs += [b + 1 for b in word] + [partial_matching.WORD_END]
        signs.append(partial_matching.TEXT_END)
        want += [(number, sum(s << (9 * j) for j, s in enumerate(signs[max(0, i - 6) : i + 1][::-1]))) for i in range(1, len(signs))]
    assert got == want


def test_gram_counts_beyond_memory():
    """Counts that are sent in parts sum up to the whole."""
    import pyarrow as pa

    texts = ["the cat sat on the mat", "a dog ran off", "the cat ran"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sums = []
    for held in (1, 20, 10**6):
        total = {}
        for part in partial_matching._count_grams(5, held)(iter([batch])):
            for gram, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                total[gram] = total.get(gram, 0) + n
        sums.append(total)
    assert sums[0] == sums[1] == sums[2]


def test_grams_not_yet_merged_are_bounded(monkeypatch):
    """A task holds its different grams and at most ``loose`` and a window besides."""
    import os

    import pyarrow as pa

    from leafmill.llm import partial_matching

    merged, most = partial_matching.merged, []
    monkeypatch.setattr(partial_matching, "merged", lambda codes, counts: (most.append(sum(map(len, codes))), merged(codes, counts))[1])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(60), pa.int64()), "text": [os.urandom(3000).hex() for _ in range(60)]})
    rows = sum(part.num_rows for part in partial_matching._count_grams(5, 500_000, 5000)(iter([batch] * 3)))
    assert rows and max(most) <= 500_000 + 5000 + partial_matching.WINDOW
