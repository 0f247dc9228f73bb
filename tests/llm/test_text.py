"""Tokens, words, pages, benchmark passages and personal data."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldloom.llm import decontaminate, html_tree, pii, token_count, word_table_bpe
from foldloom.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, id string, n_bytes string, row int, word string"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EXTRA = ("i", "b", 1, "w")
ODD = [None, "", " ", "don't ünï <|endoftext|> x<|startoftext|>y", "a" * 3000, "word \n\n\t  gap " * 400, "日本語 🙂 é́ ΣΑΣ İ", "!!<|endoftext|>" * 60, "a\x1cb \x1f c\x85d", "<|startoftext|>e\u0301 <b> <|x"]


def test_token_counts_with_chunks(spark):
    texts = [r.text for r in table(spark, SF, "documents").select("text").limit(60).collect()] + ODD
    rows = [(k, t, *EXTRA) for k, t in enumerate(texts)] + [(None, "one two", *EXTRA), (0, texts[0], *EXTRA)]
    out = token_count.token_counts(spark.createDataFrame(rows, DOCS), BYTE, 100, huge=500, stride=200, overlap=60).collect()
    library = Tokenizer.from_file(BYTE)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted(
        (i is None, i or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100)
        for i, t, *_ in rows)
    assert token_count.token_counts(spark.createDataFrame([], DOCS), BYTE, 100).collect() == []


def test_words_encode_and_decode_as_the_library(spark, monkeypatch):
    monkeypatch.setattr(word_table_bpe, "HOT_WORDS", 200)
    texts = [r.text for r in table(spark, SF, "documents").select("text").limit(80).collect()] + ODD
    rows = [(k, t, *EXTRA) for k, t in enumerate(texts)] + [(None, "one two", *EXTRA), (0, texts[0], *EXTRA)]
    out = word_table_bpe.encode_decode(spark.createDataFrame(rows, DOCS), WORD).collect()
    library = Tokenizer.from_file(WORD)

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(
        (i is None, i or 0, *expected(t)) for i, t, *_ in rows)
    assert word_table_bpe.encode_decode(spark.createDataFrame([], DOCS), WORD).collect() == []


def test_masks_miss_no_window():
    """Every choice of up to three substituted tokens in a window leaves a seed of some mask whole."""
    for lost in combinations(range(decontaminate.WINDOW), 3):
        assert any(
            all(start + k not in lost for k in mask)
            for mask in decontaminate.MASKS for start in range(decontaminate.WINDOW - mask[-1]))


def test_masks_miss_no_short_item():
    """The same for items of 3 to 15 tokens, with as many substituted as 80 % leave."""
    for n in range(len(decontaminate.SHORT_MASKS[0]), decontaminate.WINDOW + 1):
        masks = decontaminate.MASKS if n == decontaminate.WINDOW else (*decontaminate.MASKS, *decontaminate.SHORT_MASKS)
        for lost in combinations(range(n), n // 5):
            assert any(all(start + k not in lost for k in mask) for mask in masks for start in range(n - mask[-1])), (n, lost)


def test_a_short_item_with_its_middle_word_substituted_leaks(spark):
    assert leaks(spark, [(1, "so alpha beta other delta epsilon there", *EXTRA)], [(10, "alpha beta gamma delta epsilon", "t", 1)]) == [(1, 10)]


def test_tiny_items_leak_as_whole_documents(spark):
    docs = [(1, "Yes!", *EXTRA), (2, "yes and no", *EXTRA), (3, "no way", *EXTRA), (4, "no way out", *EXTRA), (5, " ".join(["word"] * 50_000), *EXTRA)]
    assert leaks(spark, docs, [(10, "yes", "t", 1), (11, "no way", "t", 1), (12, "", "t", 1), (13, "no way out", "t", 1)]) == [(1, 10), (3, 11), (4, 13)]
    with pytest.raises(ValueError):
        decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string"), percent=70)


def leaks(spark, docs, items):
    found = decontaminate.leaks(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, th string, id long"))
    return sorted((r.id, r.item_id) for r in found.collect())


def test_leaks(spark):
    words = [f"w{k}" for k in range(40)]
    changed = list(words[5:20])
    for k in (2, 7, 12):
        changed[k] = "zz"
    four = list(changed)
    four[9] = "zz"
    docs = [
        (1, "before it " + " ".join(words), *EXTRA), (2, "x y " + " ".join(changed).upper() + ", z", *EXTRA), (3, " ".join(four), *EXTRA),
        (4, None, *EXTRA), (5, "", *EXTRA), (6, "tiny item here", *EXTRA), (7, "nothing of the kind", *EXTRA), (1, "before it " + " ".join(words), *EXTRA)]
    items = [(10, " ".join(words), "t", 1), (11, "tiny item here", "t", 1), (12, None, "t", 1), (13, "", "t", 1), (14, "two words", "t", 1),
             (10, " ".join(words), "t", 1)]
    assert leaks(spark, docs, items) == [(1, 10), (2, 10), (6, 11)]
    assert leaks(spark, docs, []) == [] and leaks(spark, [], items) == []
    kept = decontaminate.decontaminate(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, th string, id long"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7] and kept.columns == ["doc_id", "text", "id", "n_bytes", "row", "word"]


def test_leaks_as_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}

    def tokens(text):
        stripped = (w.strip(".,;:!?\"'()[]{}*#%&$|-") for w in re.split(r"[ \t\n\x0b\x0c\r]", text.lower()))
        return [w for w in stripped if w]

    expected = set()
    for i, t in docs.items():
        at: dict = {}
        w = tokens(t)
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        for item, text in items.items():
            v = tokens(text)
            hits: dict = {}
            for j, x in enumerate(v):
                for k in at.get(x, ()):
                    hits.setdefault(k - j, set()).add(j)
            for js in hits.values():
                if len(js) >= 12 and any(sum(1 for j in range(s, s + 15) if j in js) >= 12 for s in range(max(1, len(v) - 14))):
                    expected.add((i, item))
    found = decontaminate.leaks(table(spark, SF, "documents"), table(spark, SF, "benchmark"))
    assert {(r.id, r.item_id) for r in found.collect()} == expected and expected


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header>Top</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad box">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First  part<br><p>Second &eacute;&#8364;</p><form><p>Mail</p></form>
<div class="comments"><p>Reader</p></div><table><tr><td>a</td><td>b</td></tr></table></article>
<aside>Side</aside><footer>&copy; end</footer></body></html>"""
PAGES = "page_id long, url string, html string"


def test_pages(spark):
    rows = [
        (1, "http://h.example/a", PAGE), (2, None, None), (3, "no url", ""), (4, "http://h.example/b", "plain &lt;text&gt;\n more"),
        (5, "http://x.example", "<p>cut off inside <a href='x"), (6, "http://x.example", "<p>one<p>two &am"), (7, "http://x.example", "a < b"),
        (1, "http://h.example/a", PAGE), (None, "http://h.example/c", "<article>only</article>")]
    out = html_tree.main_texts(spark.createDataFrame(rows, PAGES)).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    assert got == {
        1: "Head & more\nFirst part\nSecond é€\na\nb", 2: "", 3: "", 4: "plain <text> more", 5: "cut off inside", 6: "one\ntwo &am", 7: "a < b",
        None: "only"}
    assert html_tree.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def site(host, n, first=0):
    return [(first + k, f"http://{host}/x", f"<body><div class='box'>Same words</div><article><h1>Title {k}</h1><div class='call'>Subscribe now</div>"
             f"<p>Own {k}</p><p>More {k * 7} and more</p></article><div class='c'>Read {k % 2}</div></body>") for k in range(n)]


def test_repeated_branches_of_a_site_are_cut(spark):
    """Branches that nothing declares as boilerplate go if their content repeats over the host's pages, on small hosts too."""
    rows = site("site.example", 60) + site("few.example", 3, 100) + site("two.example", 2, 200)
    # copies of one article: the tree may not take it
    rows += [(300 + k, "http://copies.example/x", f"<body><div>Visits {k}</div><article><h1>One</h1><p>The same article</p></article></body>") for k in range(5)]
    got = {r.page_id: r.text for r in html_tree.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[5] == "Title 5\nOwn 5\nMore 35 and more"
    assert got[101] == "Title 1\nOwn 1\nMore 7 and more\nRead 1"
    assert got[201] == "Same words\nTitle 1\nSubscribe now\nOwn 1\nMore 7 and more\nRead 1"
    assert got[303] == "Visits 3\nOne\nThe same article"


def test_importance_of_branches_as_plain_counts(spark):
    rows = site("site.example", 12) + site("few.example", 3, 100)
    rows += [(50 + k, "http://site.example/y", "<body><div class='box'>Same words<p>a<p>a<p>b</div></body>".replace("b<", f"b{k}<")) for k in range(4)]
    pages = spark.createDataFrame([("few" if i >= 100 else "site", h) for i, _, h in rows], "host string, html string")
    got = {(r.host, r.branch): (r.content, r.best, r.shape, r.importance) for r in html_tree.branch_importance(pages).collect()}
    expected = {}
    for host in ("site", "few"):
        texts, shapes, shown = {}, {}, {}
        for k, (_, _, h) in enumerate(r for r in rows if (r[0] >= 100) == (host == "few")):
            blocks, forms = html_tree.read(h)
            for b in blocks:
                texts.setdefault(b.path, {}).setdefault(b.text, set()).add(k)
            for path, form in forms:
                shapes.setdefault(path, {}).setdefault(form, set()).add(k)
            for path in [b.path for b in blocks] + [p for p, _ in forms]:
                shown.setdefault(path, set()).add(k)
        leaf = {}
        for path, found in texts.items():
            m = len(shown[path])
            mean = sum(math.log(len(on)) / math.log(m) for on in found.values()) / len(found) if m > 1 else 0
            leaf[path] = (1 - m / (m + 2) * mean, len(found))
        for path, found in shapes.items():
            below = [v for q, v in leaf.items() if q == path or q.startswith(path + "/")]
            if below:
                total, m = sum(map(len, found.values())), len(shown[path])
                varied = -sum(len(on) / total * math.log(len(on) / total) for on in found.values()) / math.log(total) if total > 1 else 1
                shape, content = 1 - m / (m + 2) * (1 - varied), sum(i * n for i, n in below) / sum(n for _, n in below)
                expected[host, path] = (content, max(i for i, _ in below), shape, 0.1 * shape + 0.9 * content)
    assert set(got) == set(expected)
    for key, values in expected.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


def test_names_are_whole_tokens(spark):
    """Names inside longer words and names of the frame take nothing away; long pages, clashing columns, rows without an id."""
    long = "<article>" + "".join(f"<p>part {k}</p>" for k in range(40_000)) + "</article>"
    pages = [
        "<body class='has-sidebar'><article><p>text</p></article></body>", "<article class='post comments-open'><p>text</p></article>",
        "<article><h1 class='entry-header'>title</h1><p>text</p></article>", "<div class='page-with-navigation'><p>text</p></div>",
        "<body class='sidebar'><main class='widget'><article class='comments'><p>text</p></article></main></body>",
        "<div class='site-footer'>no</div><article><p>text</p><div id='post-comments'>no</div><article class='comment'>no</article></article>"]
    rows = [(k, f"http://h{k}.example/", h, "x", "y", 3) for k, h in enumerate(pages)] + [(50, "http://long.example", long, "x", "y", 3)]
    rows += [(None, "http://h9.example/", pages[0], "x", "y", 3)] * 2
    out = html_tree.main_texts(spark.createDataFrame(rows, PAGES + ", host string, text string, noise int")).collect()
    got = {r.page_id: r.text for r in out}
    assert [got[k] for k in range(6)] == ["text", "text", "title\ntext", "text", "text", "text"]
    assert got[50].count("\n") == 39_999 and len(out) == len(rows) and got[None] == "text"


def test_page_texts_of_the_table(spark):
    import html

    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_tree.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


VALUES = {
    "card": "4111 1111 1111 1111", "iban": "DE89 3704 0044 0532 0130 00", "ip": "192.168.3.254", "date": "2024-02-29", "ssn": "123-45-6789",
    "phone": "+1 (017) 555-7713", "email": "ann.lee58@mail5.example.com"}
FALSE = ["4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "192.168.3.256", "2023-02-29", "000-45-6789", "31/02/2024", "token 24be64439e3e49cf46b2d7c9"]


def replaced(spark, texts, key="k"):
    rows = [(k, t, *EXTRA) for k, t in enumerate(texts)]
    out = pii.pseudonymise(spark.createDataFrame(rows, DOCS), key)
    return {r.row.doc_id: r for r in out.select("row", "text", "found").collect()}


def luhn(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_the_format(spark, kind):
    value = VALUES[kind]
    out = replaced(spark, [f"see {value}, and {value}.", f"{value} again"])
    new = out[0].found[0].new
    assert [(f.kind, f.value) for f in out[0].found] == [(kind, value)] * 2 and new != value
    assert out[0].text == f"see {new}, and {new}." and out[1].text == f"{new} again"
    assert re.sub(r"[a-z]", "a", re.sub(r"\d", "9", new)) == re.sub(r"[a-z]", "a", re.sub(r"\d", "9", value)) or kind == "ip"
    if kind == "card":
        assert luhn(new)
    if kind == "ip":
        assert all(0 <= int(x) < 256 for x in new.split("."))
    assert replaced(spark, [value], key="other")[0].text != new
    assert replaced(spark, [new])[0].found[0].kind == kind  # valid again


def test_values_that_fail_are_left_alone(spark):
    out = replaced(spark, [*FALSE, None, "", "clean text 12 34"])
    assert all(out[k].text == t and not out[k].found for k, t in enumerate([*FALSE, None, "", "clean text 12 34"]))
    assert pii.pseudonymise(spark.createDataFrame([], DOCS), "k").collect() == []


def test_values_without_three_digits_in_a_row(spark):
    """Values in groups of one or two digits are found where a text holds nothing else, and stay linked."""
    values = ["+49 30 12 34 56", "+33 12 34 56 78 90", "41 11 11 11 11 11 11 11", "-".join("4111111111111111")]
    out = replaced(spark, [t for v in values for t in (f"see {v}", f"in 2024 see {v}")])
    for k, v in enumerate(values):
        alone, other = out[2 * k], out[2 * k + 1]
        assert [f.value for f in alone.found] == [v] and alone.found == other.found
        assert alone.text == f"see {alone.found[0].new}" != f"see {v}" and other.text == f"in 2024 {alone.text}"


def test_permutations_map_no_two_values_to_one(spark):
    numbers = spark.range(1000).select(F.col("id"), F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    for n in numbers.select(pii.permuted_digits(F.col("d"), "k", "x").alias("p")).distinct().collect():
        assert re.fullmatch(r"\d{3}", n.p)
    assert numbers.select(pii.permuted_digits(F.col("d"), "k", "x")).distinct().count() == 1000
    days = spark.range(146_097).select(pii.permuted_number(F.col("id"), pii.CYCLE_FACTORS, "k", "date").alias("p"))
    assert days.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()[:] == (146_097, 0, 146_096)
