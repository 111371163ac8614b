import math
import unicodedata
import zlib
from collections import Counter

from quadrill.llm import langid

EN, DE = "the cat sat on the mat and the dog", "der hund und die katze sind auf dem dach"
SCHEMA = "doc_id long, text string, lang string, score int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def learnable(n):
    return [k for k in range(10 * n) if zlib.crc32(str(k).encode()) % 3 != 1][:n]


def test_words_then_shorter_ngrams():
    model = langid.Model.learn({"en": Counter(EN.split()), "de": Counter(DE.split())})
    assert model.langs == ["de", "en"] and "the" in model.tables[0] and "mat" in model.tables[0] and "qqq" not in model.tables[0]
    assert model.predict("the dog")[0] == "en" and model.predict("der hund")[0] == "de"
    assert model.predict("thez")[0] == "en" and model.predict("katzen")[0] == "de"  # unseen words
    assert (model.unseen("日本") == 0).all() or len(model.unseen("日本")) == 2
    assert "katzen" in model.kept


def plain_words(text):
    """Runs of letters, and of marks after a letter, character by character."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha() or word and unicodedata.category(c).startswith("M"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


class Dictionary:
    """The same rule over plain dictionaries."""

    def __init__(self, rows):
        self.langs = sorted({lang for _, lang in rows})
        self.tables = [{lang: Counter() for lang in self.langs} for _ in range(6)]
        for text, lang in rows:
            for word in plain_words(text):
                for n in range(6):
                    self.tables[n][lang].update(self.parts(word, n))

    @staticmethod
    def parts(word, n):
        padded = f"\x02{word}\x03"
        return [padded[k : k + n] for k in range(len(padded) - n + 1)] if n else [word]

    def log(self, n, part, lang):
        table = self.tables[n]
        entries = len(set().union(*table.values()))
        return math.log(table[lang][part] + 0.5) - math.log(sum(table[lang].values()) + 0.5 * entries)

    def predict(self, text):
        words = plain_words(text or "")
        if not words or not self.langs:
            return "und"
        total = dict.fromkeys(self.langs, 0.0)
        for word in words:
            for n in (0, 5, 4, 3, 2, 1):
                known = [p for p in self.parts(word, n) if any(p in c for c in self.tables[n].values())]
                if known:
                    for lang in self.langs:
                        total[lang] += sum(self.log(n, p, lang) for p in known) / len(known)
                    break
        return max(self.langs, key=lambda lang: (round(total[lang], 9), -self.langs.index(lang)))


def test_against_dictionaries(spark):
    parts = ["the cat", "der hund", "le chat noir", "katzen", "catch", "noire", "हिन्दी में", "हिन्दी", "été", "x", "Ünd", "ǅ", "日本"]
    langs = ["en", "de", "fr", "en", "en", "fr", "hi", "hi", "fr", "en", "de", "de", "ja"]
    ids = learnable(3 * len(parts))
    rows = [(i, f"{parts[k % len(parts)]} {parts[k * 7 % len(parts)]}", langs[k % len(parts)]) for k, i in enumerate(ids)]
    outs = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1][:60]
    rows += [(i, f"{parts[k % 13]}s {parts[k * 5 % 13]} {parts[k * 11 % 13][:2]}", "zz") for k, i in enumerate(outs)]
    model = Dictionary([(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    got = {r.doc_id: r.lang_pred for r in langid.identify(table(spark, rows)).collect()}
    assert got == {i: model.predict(t) for i, t, _ in rows}


def test_und_is_for_texts_without_a_letter(spark):
    rows = [(i, (EN, DE)[k % 2], ("en", "de")[k % 2]) for k, i in enumerate(learnable(8))]
    odd = ["\u00b2 \u00bd", "\u2167", "\u2460", "_ 1 \u0301", "\u00aa", "the \u00b2"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table(spark, rows + [(1000 + k, t, None) for k, t in enumerate(odd)])).collect()}
    assert [got[1000 + k][0] == "und" for k in range(6)] == [True, True, True, True, False, False] and got[1000][1] == 0


def test_ties_and_rare_languages(spark):
    ids = learnable(42)
    rows = [(i, EN, "en") for i in ids[:40]] + [(ids[40], "same words", "xb"), (ids[41], "same words", "xa")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(table(spark, rows), sample_mb=0.0005).collect()}
    assert got[ids[40]] == got[ids[41]] == "xa" and got[ids[0]] == "en"


def test_odd_rows(spark):
    ids = learnable(8)
    rows = [(i, (EN, DE)[k % 2], ("en", "de")[k % 2]) for k, i in enumerate(ids)]
    odd = [(901, None, "en"), (902, "", "en"), (903, "12 34 !!", "de"), (904, "the mat " * 20000, None), (904, "der", "de"), (None, "und die", None)]
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred) for r in langid.identify(table(spark, rows + odd)).collect())
    want = [(str(i), zlib.crc32(str(i).encode()) % 3 == 1, lang) for i, _, lang in rows]
    want += [(str(i), zlib.crc32(str(i if i is not None else "").encode()) % 3 == 1, p) for (i, _, _), p in zip(odd, ["und", "und", "und", "en", "de", "de"], strict=True)]
    assert got == sorted(want)


def test_nothing_to_learn_from(spark):
    assert [r.lang_pred for r in langid.identify(table(spark, [(2, "some text", None)])).collect()] == ["und"]
    assert langid.identify(table(spark, [])).collect() == []


def test_held_out_rows_are_not_learned_from(spark):
    outs = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1][:4]
    rows = [(i, EN, "en") for i in learnable(4)] + [(i, DE, "de") for i in outs]
    assert {r.lang_pred for r in langid.identify(table(spark, rows)).collect()} == {"en"}


def test_query_accuracy(spark):
    from quadrill.llm.queries import op8_language_id

    sf_dir = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_language_id(spark, sf_dir).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
