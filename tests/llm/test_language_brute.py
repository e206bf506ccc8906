"""Every document against every dictionary, one compression at a time."""

import re
import unicodedata

import zstandard

from spanview.llm import language_id as li

DATA = "/root/testdata/sf0.001"


def words_of(text):
    """Lower-case runs of letters and marks, by their categories."""
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()


def size(data, dictionary, level):
    """Bytes of data in frames of their own, each compressor made for it alone."""
    total = 0
    for at in range(0, len(data), li.CHUNK):
        frame, out = data[at : at + li.CHUNK], []
        carrier = dictionary[-li.CARRIER :] if dictionary else b""
        for content in (carrier, carrier + frame):
            if dictionary:
                known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=level)
                c = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            else:
                c = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(level, source_size=li.CHUNK, write_content_size=0, write_checksum=0, write_dict_id=0))
            out.append(len(c.compress(content)))
        total += max(1, out[1] - out[0])
    return total


def brute(text, model):
    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", None, True
    words = words_of(text)
    whole, distinct = f" {' '.join(words)} ".encode(), f" {' '.join(dict.fromkeys(words))} ".encode()
    sizes = {lang: size(whole, d, li.LEVEL) + size(distinct, d, li.DISTINCT_LEVEL) for lang, d in model}
    plain = size(whole, None, li.LEVEL) + size(distinct, None, li.DISTINCT_LEVEL)
    ranked = sorted(sizes.values())
    best = next(lang for lang, _ in model if sizes[lang] == ranked[0])
    margin = ranked[1] - ranked[0]
    return best, margin, margin < li.MARGIN * ranked[0] or ranked[0] > plain


def test_every_document_with_every_dictionary(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = li.fit(li.training_rows(docs))
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "123 ... !"), (9004, "zxq vbn wrt " * 40), (9005, re.sub("[aeiou]", "ø", rows[0][1] or "x")), (9006, "É"), (9007, "的 文字 " * 30)]
    got = {x.doc_id: (x.lang_pred, x.margin, x.rejected) for x in li.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc_id, text in rows:
        lang, margin, rejected = brute(text, model)
        assert got[doc_id][0] == lang and got[doc_id][2] == rejected, doc_id
        assert margin is None or got[doc_id][1] == margin, doc_id
    assert len(model) > 2 and any(got[d][2] for d in (9004, 9007))
