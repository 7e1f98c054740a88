import re
import zlib

import zstandard

from nichesearch.llm import language_id

from .conftest import row


def test_every_row_is_predicted_and_held_out_rows_are_right(docs, corpus):
    found = language_id.identify(docs, language_id.learn_from(docs)).collect()
    assert len(found) == len(corpus)
    langs = {r[0]: r[2] for r in corpus[:150]}
    held = [r for r in found if r.held_out and r.doc_id in langs]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in found}
    for i in (241, 242, 243, 244):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_and_ids_do_not_move_a_prediction(make, docs):
    dictionaries = language_id.learn_from(docs)
    a, b = docs.limit(1).collect()[0], None
    other = make([(999, a.text, "xx", "zz", 0, 0.0, 0, "", 0, "", 0, "")])
    a = language_id.identify(docs.limit(1), dictionaries).first()
    b = language_id.identify(other, dictionaries).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def test_empty_tables_and_no_labels(docs, nothing):
    assert language_id.identify(nothing, language_id.learn_from(nothing)).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.keep_identified(nothing).columns == nothing.columns


def test_the_stage_keeps_clean_rows_and_columns(docs):
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert set(range(150)) <= {r.doc_id for r in kept.collect()}


def test_whole_texts_count():
    model = language_id.Classifier({"a": b"alpha beta gamma delta epsilon " * 20, "b": b"uno dos tres cuatro cinco seis " * 20})
    text = "uno dos " + "alpha gamma delta epsilon beta " * 4000
    assert model.predict(text)[0] == "a"


def test_predictions_equal_brute_force(docs, corpus):
    """Every text compressed by the library, block by block, with each dictionary."""
    dictionaries = language_id.learn_from(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, dictionaries).collect()}
    for doc_id, text, *_ in corpus:
        own = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())).encode()
        if doc_id is None or not own:
            continue
        sizes = {}
        for lang, content in dictionaries.items():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress(own[i : i + 4096])) for i in range(0, len(own), 4096))
        first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        assert (got[doc_id].lang_pred, got[doc_id].margin_bytes) == (first[0], second[1] - first[1])
        assert got[doc_id].rejected == (second[1] - first[1] < max(2, 0.01 * first[1]))


def test_the_sample_is_bounded_and_all_of_it_counts(make):
    rows = [row(7, f"wort nummer {chr(97 + i % 26)} ohne ende", "de") for i in range(3000)] + [row(100 + i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 400, "en") for i in range(500)]
    found = language_id.learn(make(rows))
    assert max(map(len, found.values())) <= language_id.DICTIONARY_BYTES
    assert len(set(found["en"].split())) >= language_id.SAMPLE_DOCS // 2 and found["de"].count(b"nummer") == 1


def test_numerals_are_no_letters(make, docs):
    texts = ["½", "² ³", "12 ①", "Ⅷ", "_", "…", "١٢", "aª", "ж", "日", "½é"]
    found = {r.doc_id: r for r in language_id.identify(make([row(i, t) for i, t in enumerate(texts)]), language_id.learn_from(docs)).collect()}
    for i, t in enumerate(texts):
        assert (found[i].lang_pred == "und") == (not any(c.isalpha() for c in t)), t
    assert language_id.letters("x²y ½z 3w") == b"x y z w"
