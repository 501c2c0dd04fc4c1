import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ALPHA = "the of and to in a is it on with for was by ththan erin anhe ouing reed".split()


def prose(rng, n, words=ALPHA):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def hard_dir(tmp_path_factory):
    """Small tables with nulls, ties, repeated rows, long texts and clashing columns."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("hard")
    base = prose(rng, 300)
    near = base.split(" ")
    near[150] = "changed"
    again = " ".join(["de"] * 90)
    texts = [
        base, base, "  " + base.replace(" ", "\n"), " ".join(near), None, "", " \n\t ", "a", "a b c", again, prose(rng, 40), prose(rng, 40).upper(), "#*$ %&| <> " * 12,
        "mail me: ana.b@mail.example.com or +1 (499) 555-6503, 10.20.30.40 and 4539 1488 0343 6467.", "x" * 30_000, prose(rng, 20_000), "naïve ﬁancé é ﷽ 😀 <|endoftext|> it's\u00a0\u2003ok\x85 日本", "1.2.3.4.5 a@b a@b.c@d.e +12 +1-2-3-4-5-6-7-8",
        prose(rng, 60) + "\n" + "line one here\n" * 4, base.lower(), *[prose(rng, rng.randint(1, 120)) for _ in range(30)],
    ]
    n = len(texts)
    ids = [*range(100, 100 + n - 3), None, 101, 101]
    sources = [["src0", "src1", None, "Ä", ""][i % 5] if i % 3 else "src0" for i in range(n)]
    docs = {"doc_id": ids, "text": texts, "lang": [["en", None][i % 2] for i in range(n)], "source": sources, "n_chars": [len(t) if t else None for t in texts]}
    docs |= {c: [i % 7 for i in range(n)] for c in ("id", "t", "th", "fp", "n", "k", "score", "kept", "host", "digest", "row", "mix rate", "c0", "a.b", "component_id")}
    docs = {c: [*v, v[0], v[-1]] for c, v in docs.items()}  # whole rows again
    schema = pa.schema([(c, pa.string() if c in ("text", "lang", "source") else pa.int64()) for c in docs])
    pq.write_table(pa.table(docs, schema), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [100, 101, None, 109, 110, 111, 112, 999, 101], "quality": [1, 1, 0, 0, 1, 0, 0, 1, None], "toxic": [0, None, 0, 0, 0, 0, 0, 0, 0]}, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), folder / "labels.parquet")
    html = "<p>" + "x" * 1200 + "</p>"
    urls = ["https://www.example.com/en/1?utm_source=a", "http://Example.COM/en/2", "http://m.ads-track.example.org/x/?b=2&a=1", None, "no scheme", "http://a.net/es/", "http://a.net/esx", "http://x.org", "ftp://a.b://c/d#e", "http://example.com.evil.org/en/", "http://m.ads-track.example.org/x?a=1&b=2#f", ""]
    pages = {"page_id": [*range(11), None], "url": urls, "html": [html, html, "short", "short", None, "", html, "é" * 600, "é" * 600, "y" * 999, "y" * 999, html], "id": [1] * 12, "host": ["h"] * 12, "digest": ["d"] * 12}
    pq.write_table(pa.table(pages, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("id", pa.int64()), ("host", pa.string()), ("digest", pa.string())])), folder / "pages.parquet")
    turns = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes!\n "), (2, 5, "assistant", "No end"), (2, None, "user", "One."), (2, 9, None, "Two."), (2, 9, "tool", None),
        (None, 0, "user", "A."), (None, None, "user", "A."), (3, 0, "", " \t\n"), (3, 3, "user", "\u2003"), (3, -4, "user", "x" * 300_000 + "."), (4, 1, "assistant", "b."), (4, 0, "assistant", "b."), (4, 0, "assistant", "a.\u2028"),
        *[(5, i, ["user", "assistant", "system"][i % 5 % 3], f"t{i % 17}.") for i in range(90)], *[(6 + i % 9, i // 9, ["user", "assistant"][i // 9 % 2], f"w{i}" + "!?."[i % 3]) for i in range(60)],
    ]
    turns = [*turns, turns[0], turns[-1]]
    names = ("conv_id", "turn", "role", "text")
    talk = dict(zip(names, map(list, zip(*turns)))) | {c: [1] * len(turns) for c in ("conv", "fault", "digest", "row", "pid", "part", "lot", "col")}
    pq.write_table(pa.table(talk, pa.schema([(c, pa.string() if c in ("role", "text") else pa.int64()) for c in talk])), folder / "conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(hard_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "conversations"):
        pq.write_table(pq.read_table(f"{hard_dir}/{t}.parquet").slice(0, 0), folder / f"{t}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def docs(hard_dir):
    """(doc_id, text) of the hard table; null text is empty."""
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{hard_dir}/documents.parquet").select(["doc_id", "text"]).to_pylist()]
