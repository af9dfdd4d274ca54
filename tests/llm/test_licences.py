import random

import pytest

from docloom.llm import catalog, licences

from .helpers import as_tables, documents, empty


@pytest.fixture(scope="module")
def index():
    return licences.Templates(licences.NOTICES)


def test_band_settings_keep_their_promise():
    for length in range(1, 400):
        s = licences.least_similarity(length)
        bands, rows = licences.band_settings(s)
        assert 0 < s <= 1 and bands * rows <= licences.HASHES
        assert (1 - s**rows) ** bands <= licences.MISS or rows == 1


def test_a_window_holds_every_match():
    for length in range(1, 300):
        window, stride = licences.window_of(length)
        assert window - stride >= 1.25 * length - 1e-9


@pytest.mark.parametrize("name", licences.NOTICES)
def test_every_notice_is_found_anywhere(index, name):
    text = licences.NOTICES[name]
    for before in (0, 1, 7, 33):
        whole = "filler words " * before + text.upper() + " and more filler words" * before
        found = [m for m in index.matches(whole) if m[0] == name]
        assert len(found) == 1 and found[0][3] == 1.0
        assert licences.words_of(whole[found[0][1] : found[0][2]]) == licences.words_of(text)


def brute(text, index):
    """Licences with a stretch of up to 1.25 lengths that holds enough of their shingles."""
    shingles = licences._shingles(licences.words_of(text), 5)
    out = set()
    for name, wanted in index.shingles.items():
        reach = -(-5 * len(licences.words_of(licences.NOTICES[name])) // 4) - 4
        for i, s in enumerate(shingles):
            if s in wanted and len(wanted.intersection(shingles[i : i + max(1, reach)])) / len(wanted) >= 0.8:
                out.add(name)
                break
    return out


def test_altered_notices(index):
    words = licences.NOTICES["Apache-2.0-header"].split()
    few = [*words[:20], "indeed", *words[20:]]
    many = [w if i % 6 else "other" for i, w in enumerate(words)]
    assert "Apache-2.0-header" in {m[0] for m in index.matches(" ".join(few))}
    assert "Apache-2.0-header" not in {m[0] for m in index.matches(" ".join(many))}
    assert index.matches(None) == [] and index.matches("") == [] and index.matches("MIT License") == []


def test_query_loses_nothing(spark, sf, index):
    got = {r.doc_id: set(filter(None, r.licences.split(","))) for r in catalog.op8_licence_scan(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        assert brute(t, index) <= got[d]


def test_hard_rows(spark, tmp_path):
    got = catalog.op8_licence_scan(spark, as_tables(spark, tmp_path, documents(spark, extra=True))).collect()
    assert len(got) == 17 and all(r.n_matches == 0 and r.licences == "" and r.spans == "" for r in got)
    assert licences.scan(empty(spark)).collect() == []
    assert licences.scan(documents(spark), {}).count() == 17
    with pytest.raises(ValueError):
        licences.scan(empty(spark), {"long": "word " * 200_001})


def test_repeated_notice_and_own_templates(index):
    two = "Released under the MIT License. " + "x y z " * 20 + "released under the MIT license"
    assert [m[0] for m in index.matches(two)] == ["MIT", "MIT"]
    short = licences.Templates({"own": "do as you like", "none": ""})
    assert [(m[0], m[3]) for m in short.matches("Do as you like!")] == [("own", 1.0)]


def test_registered_licences_keep_their_names():
    texts = licences.registered()
    assert sum(len(licences.words_of(t)) for t in texts.values()) <= licences.MAX_TEMPLATE_WORDS
    every = licences.Templates(texts)
    for name, text in texts.items():
        found = {m[0]: m for m in every.matches("some words before it " + text + " and after it")}
        assert found[name][3] == 1.0, name
        length = found[name][2] - found[name][1]
        assert [n for n, m in found.items() if m[2] - m[1] > length / 2] == [name]
    families = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "MPL-2.0"}
    assert {f"{f}-text" for f in families} <= texts.keys()
    assert {"BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC-BY-SA-4.0"} <= texts.keys()
    assert [m[0] for m in every.matches(licences.OTHERS["GPL-2.0"])] == ["GPL-2.0"]


@pytest.fixture(scope="module")
def every():
    return licences.Templates(licences.registered())


def shares(text, index, reach):
    """Licences of which the whole text holds 0.8 of the shingles; too short for pieces: ``reach`` words of it."""
    shingles = licences._shingles(licences.words_of(text), 5)
    own, out = set(shingles), set()
    for name, wanted in index.shingles.items():
        if len(own & wanted) / len(wanted) < 0.8:
            continue
        if licences.piece_length(index.length[name]) is None:
            size = max(1, reach(index.length[name]) - 4)
            stretches = (wanted.intersection(shingles[i : i + size]) for i in range(len(shingles)))
            if max(map(len, stretches)) / len(wanted) < 0.8:
                continue
        out.add(name)
    return out


def test_interrupted_anywhere(every):
    """One interruption of 700 words, at several places of each template that has pieces."""
    for name, text in licences.registered().items():
        words = licences.words_of(text)
        if licences.piece_length(len(words)) is None:
            continue
        for k in range(1, 13) if len(words) < 300 else (5,) if len(words) < 2_000 else ():
            cut = k * len(words) // 13
            whole = [*words[:cut], *(f"w{i}" for i in range(700)), *words[cut:]]
            if len(set(licences._shingles(whole, 5)) & every.shingles[name]) / len(every.shingles[name]) < 0.8:
                continue
            spans = every.found(whole)[name]
            assert len(spans) == 1 and spans[0][2] >= 0.8, (name, k)


def test_interrupted_spans_and_copies(every):
    header = licences.NOTICES["Apache-2.0-header"]
    words = header.split()
    broken = " ".join([*words[:25], *["page"] * 300, *words[25:]])
    text = "  and other words ".join([f"intro {broken}" + " far" * 100, header, "far " * 100 + f"{broken} outro"])
    spans = [m for m in every.matches(text) if m[0] == "Apache-2.0-header"]
    assert len(spans) == 3
    assert [text[a:z].split()[0] for _, a, z, _ in spans] == ["Licensed"] * 3
    assert [text[a:z].split()[-1] for _, a, z, _ in spans] == ["implied"] * 3
    assert [s < 1 for *_, s in spans] == [True, False, True]


def test_two_sided_brute_force_over_all_templates(spark, sf, every):
    """Before rivals go, a text's licences are those of which enough is held, wherever it stands."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    registered = licences.registered()
    rng = random.Random(5)
    names = [n for n in registered if len(licences.words_of(registered[n])) < 400]
    for _ in range(60):
        parts = []
        for name in rng.sample(names, 3):
            words = registered[name].split()
            cut = rng.randrange(len(words) + 1)
            if licences.piece_length(len(licences.words_of(registered[name]))) is None:
                cut = 0
            parts += [*words[:cut], *(f"x{rng.randrange(50)}" for _ in range(rng.randrange(400))), *words[cut:]]
        texts.append(" ".join(parts))
    for t in texts:
        got = set(every.found(licences.words_of(t)))
        assert shares(t, every, lambda n: -(-5 * n // 4)) <= got <= shares(t, every, lambda n: licences.window_of(n)[0])


def test_wordings(every):
    said = {
        "Licensed under the MIT license": "MIT",
        "Released under the BSD 3-Clause License": "BSD-3-Clause",
        "licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
        "Distributed under the GNU GPL v3.": "GPL-3.0",
        "This is available under the Apache License 2.0!": "Apache-2.0",
    }
    for text, licence in said.items():
        assert {m[0].split("/")[0] for m in every.matches(f"some words. {text} more words")} == {licence}
    for text in ("licensed under the", "the MIT License", "licensed under protest by the MIT"):
        assert every.matches(text) == []


def test_header_is_one_match(every):
    assert [m[0] for m in every.matches(licences.NOTICES["Apache-2.0-header"])] == ["Apache-2.0-header"]
