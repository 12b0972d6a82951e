"""op11 to op13 by brute force: whole trees, lists of tokens, and pages whose article is known."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loamdex.llm import alignment, merkle, wrappers  # noqa: E402

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = str.maketrans(UPPER, UPPER.lower())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, _group int"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        run = level[first : first + 8]
        yield "".join(run[: i - first]), "".join(run[i - first + 1 :])
        i //= 8


def brute_proofs(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    by_lang = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf, tampered = (digest("".join(map(field, (doc_id, source, lang, n_chars, t)))) for t in (text, text and text.translate(LOWERED)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by_lang.setdefault(lang, []).append((doc_id, leaf, tampered if hit else leaf))
    for leaves in by_lang.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    order = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree_of([x[1] for x in by_lang[k]]) for k in order}
    top = tree_of([trees[k][-1][0] for k in order])
    for at, lang in enumerate(order):
        for i, (doc_id, leaf, tampered) in enumerate(by_lang[lang]):
            steps = [*siblings(trees[lang], i), *siblings(top, at)]
            node = tampered
            for left, right in steps:
                node = digest(left + node + right)
            yield doc_id, leaf, trees[lang][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), node, node == top[-1][0]


def documents(n):
    rng = random.Random(5)
    rows = [(i * 7 % 1000, f"Text {i} É", rng.choice(["en", "en", "en", "de", "", None, "ﬁ", "𝄞"]), "web", i) for i in range(n)]
    return [*rows, (1, None, "en", None, None), (1, "", "en", "web", 0), (None, "A" * 300_000, "fr", "web", 3), (None, "x", "en", "web", 1), *[(4, "Same Row", "en", "web", 8)] * 9]


@pytest.mark.parametrize(("rows", "n"), [(100_000, 40), (7, 300), (60, 700), (1, 12)])
def test_proofs(spark, monkeypatch, rows, n):
    monkeypatch.setattr(merkle, "ROWS", rows)
    made = documents(n)
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in made], SCHEMA)
    got = sorted(map(str, map(tuple, merkle.document_proofs(df).collect())))
    assert got == sorted(map(str, brute_proofs(made)))


def test_proofs_of_one_row_and_none(spark):
    one = [(3, "Only", "en", "web", 4)]
    schema = ", ".join(SCHEMA.split(", ")[:5])
    df = spark.createDataFrame(one, schema)
    ((_, leaf, subroot, root, proof, _, _),) = merkle.document_proofs(df).collect()
    assert leaf == subroot == root and proof == digest("")
    assert merkle.document_proofs(df.where("doc_id < 0")).collect() == []


def test_manifest_and_proofs_keep_columns(spark):
    leaves = spark.createDataFrame([("a", i, digest(str(i)), f"kept {i}") for i in range(20)] + [("b", 1, digest("x"), "kept")], "g string, k int, leaf string, proof string")
    found = {r.g: r for r in merkle.manifest(leaves, "g", ["k"]).collect()}
    a = tree_of([digest(str(i)) for i in range(20)])[-1][0]
    assert (found["a"].n_leaves, found["a"].subroot, found["b"].subroot) == (20, a, digest("x"))
    assert found["a"].root == found["b"].root == digest(a + digest("x"))
    with_proofs = merkle.proofs(leaves, "g", ["k"])
    assert with_proofs.where(merkle.folded(with_proofs["leaf"], with_proofs["proof"]) == with_proofs["root"]).count() == 21


TEXTS = [
    (1, None), (2, ""), (3, "a"), (4, "a" * 5000 + " é漢字 \t\n  x<|endoftext|> </s> <s>"), (5, "漢字かな交じり文" * 300), (6, "a▁b  c"), (7, "ﬁ Ⅷ  x"), (7, "ﬁ Ⅷ  x"),
    (None, "hello world"), (9, " "), (10, "\x00 ​ q\r\n"), (11, "🙂🙃👩‍👩‍👧" * 50), (12, "the cat sat on the mat " * 400),
]


def brute_alignments(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = {t: i for t, i in tokenizer.get_vocab().items()}
    single = {i: chr(c) for c in range(0x180) for i in [vocabulary.get(chr(c))] if i is not None}
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    assert set(byte) == set(single.values())

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found = []
    for doc_id, text in rows:
        groups = None
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False), model.encode(text)
            a_bytes, b_bytes = [bytes(byte[c] for c in t) for t in a.tokens], [piece(i) for i in b]
            if b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
                groups, x, y, n, m = [], [], [], 0, 0
                rest = list(zip(b, b_bytes))
                for i, t in zip(a.ids, a_bytes):
                    n += len(t)
                    x.append(i)
                    while rest and m + len(rest[0][1]) <= n:
                        j, u = rest.pop(0)
                        m += len(u)
                        y.append(j)
                    if n == m and y:
                        groups.append((x, y))
                        x, y = [], []
        found.append((doc_id, groups))
    count = Counter(p for _, groups in found for p in {(i, j) for x, y in groups or [] for i in x for j in y})
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    for doc_id, groups in found:
        links = [(i, j) for x, y in groups or [] for i in x for j in y]
        joined = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        yield (doc_id, sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), len(links),
               sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest(joined) if groups else "")


@pytest.mark.parametrize(("hot", "spelled", "groups", "kept"), [(None, 4_096, 100_000, 2_000_000), (7, 1, 3, 5), (0, 0, 1, 1)])
def test_alignment(spark, monkeypatch, hot, spelled, groups, kept):
    for name, value in (("SPELLED", spelled), ("GROUPS", groups), ("KEPT", kept)):
        monkeypatch.setattr(alignment, name, value)
    df = spark.createDataFrame([(*r, 1, "x") for r in TEXTS], "doc_id long, text string, pair int, _n string")
    got = alignment.aligned_documents(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), hot)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_alignments(TEXTS)))


def test_alignment_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned_documents(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_groups_are_given(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    (row,) = alignment.alignments(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), spelled=True).collect()
    assert row.groups.count(";") == row.n_groups - 1 and digest(row.groups) == row.groups_sha256


def sentences(rng, i, n):
    return [f"Sentence {i} {j} of the story &amp; more words here, number {rng.random()}." for j in range(n)]


def named(rng, i):
    """A content element by its class, with an advert inside, unclosed paragraphs, and comments behind it."""
    ps = sentences(rng, i, rng.randint(1, 9))
    page = (f"<html><head><title>x</title></head><body><header><h1>My site</h1><form><input name=q><button>Go</button></form></header><div id=menu><a href=a>Home</a><a href=b>News</a></div>"
            f"<div class=wrap><div class='content'><h2>Title {i}</h2>{''.join(f'<p>{p}' for p in ps)}<div class=ad-box><p>Buy now</p></div><p>Last &eacute; <a href=x>link</a>\n\t end</div>"
            "<div class='sidebar'><ul><li>a<li>b</ul></div></div><div id=comments><h3>Comments</h3><p>Nice</p></div><footer>c</footer>")  # fmt: skip
    return page, "\n".join([f"Title {i}", *map(html.unescape, ps), "Last é link end"])


def unnamed(rng, i):
    """Nothing but div: menu, notice and footer are found by their links and their sameness."""
    heads = [(f"Head {i}.{k}", *sentences(rng, i, 2)) for k in range(rng.randint(1, 4))]
    inner = "".join(f"<h3>{h}</h3><p>{a}</p><p>{b}</p>" for h, a, b in heads)
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><div><p>We use cookies on this site.</p></div><div>{inner}</div></div><div>Copyright 2020 all things</div></body>"
    return page, "\n".join(html.unescape(x) for of in heads for x in of)


def marked(rng, i):
    """An article element with lists, tables, and parts that aren't text."""
    a, b, c = sentences(rng, i, 3)
    page = (f"<main><nav>n</nav><article><h1>T{i}</h1><ul><li>{a}</li><li>x <b>bold</b></li></ul><table><tr><td>c1<td>c2</table><p>{b}</p><!-- <p>no</p> --><blockquote><p>{c}</p></blockquote>"
            "<script>if(a<b){'</p>'}</script><aside>rel</aside><section class='comments'><p>cm</p></section></article></main>")  # fmt: skip
    return page, "\n".join(map(html.unescape, [f"T{i}", a, "x bold", "c1", "c2", b, c]))


ODD = [(9001, None, "<article><p>no host", "no host"), (9002, "https://a.example/", None, ""), (9003, "https://a.example/", "", ""), (9004, "x", "plain &lt;text", "plain <text"), (9005, "https://one.example/p", "a < b <p class='x>y", None),
       (9006, "https://long.example/", "<article>" + "<p>word word</p>" * 20_000 + "</article>", "\n".join(["word word"] * 20_000)), (None, "https://a.example/", "<nav>menu</nav>", "")]


@pytest.mark.parametrize(("sent", "kept"), [(None, 5_000), (1, 2), (0, 0)])
def test_main_texts(spark, monkeypatch, sent, kept):
    monkeypatch.setattr(wrappers, "KEPT", kept)
    rng, rows = random.Random(3), []
    for k, (layout, n) in enumerate(((named, 12), (unnamed, 12), (marked, 30), (named, 1), (unnamed, 1), (marked, 2))):
        made = [layout(rng, i) for i in range(n)]
        rows += [(len(rows) + i, f"https://Host{k}.example:80/p/{i}", page, text) for i, (page, text) in enumerate([*made, *made[:3]])]
    df = spark.createDataFrame([(p, u, h, "host", 1) for p, u, h, _ in rows + ODD], "page_id long, url string, html string, host string, wrapper int")
    got = {(r.page_id, r.url): r for r in wrappers.main_texts(df, sent).collect()}
    assert len(got) == len(rows + ODD)
    for page_id, url, _, text in rows + ODD:
        r = got[page_id, url]
        assert text is None or r.text == text, url
        assert r.n_chars == len(r.text)


def test_many_structures_of_one_host(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        parts = [(tag, f"{tag} {i} {rng.random()}") for tag in rng.choices(["p", "h2", "pre", "blockquote", "figure", "h4"], k=rng.randint(1, 12))]
        rows.append((i, f"http://h/{i}", f"<nav>menu</nav><div class='article'>{''.join(f'<{t}>{x}</{t}>' for t, x in parts)}</div><div class=footer>f</div>", "\n".join(x for _, x in parts)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, expected string")
    assert wrappers.main_texts(df).join(df.select("page_id", "expected"), "page_id").where("text <> expected").count() == 0
    (wrapper,) = wrappers.wrappers(df).collect()
    assert wrapper.pages == 300 and wrapper.regex.startswith("(<nav>#</nav> <div.article>")


def test_regex_of_a_wrapper():
    pages = ["<ul><li>a<li>b</ul><h1>x</h1><p>y", "<ul><li>a</ul><h1>z</h1><p>y<p>w<table><tr><td>1</table>"]
    first, second = (wrappers.described(wrappers.parse(p)) for p in pages)
    assert wrappers.merged(first, second).regex() == "(<ul>(<li>#</li>)+</ul> <h1>#</h1> (<p>#</p>)+ (<table><tr><td>#</td></tr></table>)?)"


def test_no_pages(spark):
    assert wrappers.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
