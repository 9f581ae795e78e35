"""The training-data problems: brute force, held-out cases and edge cases."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeatlas.llm import canonical, copies, entities, leaks, mixing, stuffing
from lodeatlas.llm.names import NameDictionary, Similar, distance, fillers_beside, fold, frequent_words
from lodeatlas.llm.offers import Vendors, read_context, read_model, read_month, read_offer, read_price
from lodeatlas.llm.words import WORD, words
from lodeatlas.plans import skew

FAMILIES = [("gladraed", ""), ("gladraed", "large"), ("gladraed", "ultra"), ("fistin", ""), ("fistin", "coder"), ("mechalt", ""), ("mechalt", "nano"), ("thijitaen", ""), ("thijitaen", "medium")]
ENTRIES = [(i, f, v, "x") for i, (f, v) in enumerate(FAMILIES, 1)]
PROVIDERS = ["sofeiv-ai", "skanod-labs", "tachuvas-compute", "zikria"]


@pytest.fixture(scope="module")
def names():
    return NameDictionary(FAMILIES, PROVIDERS)


# --- words and names ---------------------------------------------------------------------------------


def test_words():
    assert words("<p>The&nbsp;Wo​rd,<br/>**bold** a<b>b</b>c [x](http://y/z)</p>") == ["the", "word", "bold", "abc", "x"]
    assert words(None) == [] == words("") == words(" ​ ")
    assert words("５ < 6_7") == ["5", "6", "7"]


def test_distance_counts_swaps_once():
    assert distance("abcd", "abdc", 2) == 1 and distance("abc", "abc", 2) == 0 and distance("abc", "xyz", 2) > 2


def test_similar_is_symmetric_to_brute_force():
    rng = random.Random(1)
    vocabulary = {"".join(rng.choice("aeioubdgkl") for _ in range(8)) for _ in range(60)}
    s = Similar(vocabulary, skeletons=False)
    for w in list(vocabulary)[:30]:
        typo = w[:3] + w[4:]
        near = sorted((distance(typo, v, 2), v) for v in vocabulary if distance(typo, v, 2) <= 2)
        expected = near[0] if near and (len(near) == 1 or near[1][0] > near[0][0]) else None
        assert s.find(typo) == expected


@pytest.mark.parametrize(
    "text,family,variant",
    [
        ("Gladraed-Large", "gladraed", "large"), ("SKanod LAbs gladraed", "gladraed", ""), ("Coder/Fistin", "fistin", "coder"), ("glad-raed ultra V10.3", "gladraed", "ultra"),
        ("gladrаed (models)", "gladraed", ""), ("THJTN_MEDIUM", "thijitaen", "medium"), ("mehcalt  nano series", "mechalt", "nano"), ("fistincoder", "fistin", "coder"),
        ("fistni.codre", "fistin", "coder"), ("ｍｅｃｈａｌｔ", "mechalt", ""), ("see notes", "", ""), ("Sabriquom", "", ""), ("TBD", "", ""), ("?", "", ""), ("v2", "", ""),
    ],
)
def test_reading_names(names, text, family, variant):
    got = names.read(text)
    assert (got.family, got.variants[0] if got.variants and got.family else "") == (family, variant)


def test_fold():
    assert fold("ＦＩstin­ Éа") == "fistin ea"


# --- 6: free-entered values ---------------------------------------------------------------------------


def test_canonical_values(spark, rows):
    entries = spark.createDataFrame(ENTRIES, "ref_id long, family string, variant string, x string")
    makers = spark.createDataFrame([(p,) for p in PROVIDERS], "provider string")
    values = [(100, "Gladraed"), (101, "gladraed large"), (102, "mechalt large"), (103, "  "), (104, None), (105, "nothing like it"), (106, ""), (106, "fistin"), (107, "gladraed " * 20_000)]
    got = rows(canonical.resolve_values(spark.createDataFrame(values, "row_id long, value string"), entries, makers).select("row_id", "ref_id"))
    assert got == [(100, 1), (101, 2), (102, 0), (105, 0), (106, 4), (107, 1)]
    none = spark.createDataFrame([], "row_id long, value string")
    assert rows(canonical.resolve_values(none, entries, makers)) == []
    assert rows(canonical.resolve_values(spark.createDataFrame([(1, "gladraed")], "row_id long, value string"), entries.limit(0), makers.limit(0)).select("ref_id")) == [(0,)]


def test_canonical_values_in_several_passes(spark, rows, monkeypatch):
    entries = spark.createDataFrame(ENTRIES, "ref_id long, family string, variant string, x string")
    makers = spark.createDataFrame([(p,) for p in PROVIDERS], "provider string")
    values = spark.createDataFrame([(1, "Gladraed Ultra"), (2, "fistin"), (3, "mechalt nano"), (4, "nobody")], "row_id long, value string")
    monkeypatch.setattr(canonical, "NAMES_PER_PART", 4)
    assert rows(canonical.resolve_values(values, entries, makers).select("row_id", "ref_id")) == [(1, 3), (2, 4), (3, 7), (4, 0)]


CITIES = [("new york city", ""), ("new york", "state"), ("san francisco", ""), ("st. john's", ""), ("gpt-4o", ""), ("gpt-4o", "mini"), ("phi 3", ""), ("phi 4", "")]


@pytest.mark.parametrize(
    "text,family,variant",
    [
        ("New-York City", "newyorkcity", ""), ("city of york, new", "newyorkcity", ""), ("Fransisco (San)", "sanfrancisco", ""), ("GPT 4o mini", "gpt4o", "mini"), ("gpt4o-mini api", "gpt4o", "mini"),
        ("phi-4", "phi4", ""), ("phi-3!", "phi3", ""), ("John's, St", "stjohns", ""), ("York", "", ""), ("", "", ""),
    ],
)
def test_token_sets(text, family, variant):
    got = NameDictionary(CITIES).read(text)
    assert (got.family, got.variants[0] if got.variants and got.family else "") == (family, variant)


def test_parts_of_a_dictionary_answer_as_the_whole(spark, rows, monkeypatch):
    rng = random.Random(5)
    entries = [(i, f, v, "x") for i, (f, v) in enumerate([*FAMILIES, *CITIES, ("gladraet", ""), ("fistim", "coder")], 1)]
    typed = []
    for i in range(150):
        _, f, v, _ = rng.choice(entries)
        parts = [typo(rng, f) if rng.random() < 0.5 else f, *([typo(rng, v) if rng.random() < 0.3 else v] if v else []), *([rng.choice(PROVIDERS)] if rng.random() < 0.3 else [])]
        rng.shuffle(parts)
        typed.append((i, rng.choice(["", " "]).join(parts) + rng.choice(["", " v3", " series"])))
    values = spark.createDataFrame(typed, "row_id long, value string")
    entries = spark.createDataFrame(entries, "ref_id long, family string, variant string, x string")
    makers = spark.createDataFrame([(p,) for p in PROVIDERS], "provider string")
    whole = rows(canonical.resolve_values(values, entries, makers))
    for n in (3, 7):
        monkeypatch.setattr(canonical, "NAMES_PER_PART", n)
        assert rows(canonical.resolve_values(values, entries, makers)) == whole
    assert sum(r[1] > 0 for r in whole) > 90


def test_fillers_are_learned(spark):
    typed = [f"{w} line {i}" for i in range(30) for w in ("gladraed", "fistin")] + ["sofa"] * 50
    often = frequent_words(spark.createDataFrame([(t,) for t in typed], "value string"), "value")
    assert fillers_beside(often, NameDictionary(FAMILIES, PROVIDERS)) == {"line"}


def typo(rng: random.Random, word: str) -> str:
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + rng.choice("aeiou") + word[i:]])


def test_canonical_values_held_out(names):
    rng = random.Random(7)
    right = total = 0
    for _ in range(300):
        f, v = rng.choice(FAMILIES)
        parts = [typo(rng, f) if rng.random() < 0.6 else f, *([v] if v else [])]
        rng.shuffle(parts)
        text = rng.choice(["", "Zikria/", "sofeiv ai "]) + rng.choice([" ", "-", "/"]).join(parts) + rng.choice(["", " v3.1", " series"])
        got = names.read(rng.choice([str.upper, str.title, str])(text))
        total += 1
        right += (got.family, got.variants[0] if got.variants else "") == (f, v)
    assert right / total >= 0.98


# --- 4: copies -------------------------------------------------------------------------------------------


def bag(*texts):
    return tuple(sorted(WORD.findall(unicodedata.normalize("NFKC", " ".join(t or "" for t in texts)).casefold())))


def test_copies(spark, rows):
    rng = random.Random(2)
    base = [("a-b 1.5", "A B"), ("x_y", "Z"), ("q", None), (None, None), ("", "…"), ("ｑ", ""), ("long " * 20_000, "x")]
    data = []
    for i in range(120):
        one, two = rng.choice(base)
        text = [*(one or "").split(" "), *(two or "").split(" ")] if len(one or "") < 99 else [one, two]
        rng.shuffle(text)
        cut = rng.randrange(len(text) + 1)
        joined = rng.choice([" ", " / ", "-  "])
        data.append((i, rng.choice(["p", "q", None]), rng.choice([str, str.upper])(joined.join(text[:cut])) or None, joined.join(text[cut:]), "clash", i))
    df = spark.createDataFrame(data, "row_id long, provider string, model_id string, display_name string, spelled string, length long")
    classes = defaultdict(list)
    for r in data:
        classes[(r[1], bag(r[2], r[3]))].append(r[0])
    expected = {(i, min(c), len(c)) for c in classes.values() if len(c) > 1 for i in c}
    got = copies.copy_classes(df, "row_id", ["provider"], ["model_id", "display_name"])
    assert set(rows(got)) == expected
    assert copies.collapse(df, "row_id", ["provider"], ["model_id", "display_name"]).count() == len(classes)
    assert rows(copies.copy_classes(df.limit(0), "row_id", ["provider"], ["model_id", "display_name"])) == []


# --- 7: leaks -----------------------------------------------------------------------------------------------


def test_leaks_brute_force(spark, rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            item = rng.choice(items)[1].split()
            n = rng.choice([11, 12, 14])
            a = rng.randrange(max(1, len(item) - n + 1))
            text[len(text) // 2 : len(text) // 2] = item[a : a + n]
        docs.append((d, rng.choice([" ", "\n", ", ", "<b> </b>"]).join(text), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[-1][1], "x"), (102, ("w1 " * 30_000) + items[3][1], "x")]
    items += [(50, None), (51, ""), (52, "one two three"), (None, "w1 " * 20)]
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            if i is not None:
                grams[tuple(w[k : k + 12])].add(i)
    expected = {(i, d) for d, t, _ in docs if d is not None for w in [words(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    df = spark.createDataFrame(docs, "doc_id long, text string, term string")
    qs = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaks(df, qs)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == expected and len(expected) > 10
    assert all(r.n_words >= 12 for r in got.collect())
    assert rows(leaks.leaks(df.limit(0), qs)) == [] and rows(leaks.leaks(df, qs.limit(0))) == []


def test_a_filter_that_lets_everything_pass(spark, rows, monkeypatch):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    items = spark.createDataFrame([(k, text(k)) for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before " + text(k) + " after") for k in range(9)] + [(50, None), (51, ""), (52, "one")], "doc_id long, text string")
    want = [(k, k, 0, 1, 20) for k in range(9)]
    assert rows(leaks.leaks(docs, items)) == want
    monkeypatch.setattr(leaks, "MOST_BITS", 1)
    monkeypatch.setattr(leaks, "_passes", lambda held, terms: np.ones(len(terms), bool))
    assert rows(leaks.leaks(docs, items)) == want


def test_filter_keeps_all_terms(spark):
    terms = spark.range(3000).select(F.abs(F.xxhash64("id")).alias("term"))
    held = leaks.term_filter(terms)
    assert leaks._passes(held, np.array([r.term for r in terms.collect()])).all()
    others = np.array([r.term for r in spark.range(5000, 9000).select(F.abs(F.xxhash64("id")).alias("term")).collect()])
    assert leaks._passes(held, others).mean() < 0.1


def test_near_leaks(spark, rows):
    w = [f"word{i}" for i in range(40)]
    changed = " ".join(x if i % 6 != 5 else "other" for i, x in enumerate(w))
    inserted = " ".join(x + (" so to say" if i % 15 == 14 else "") for i, x in enumerate(w))
    docs = [(1, changed), (2, inserted), (3, " ".join(reversed(w))), (4, " ".join(w[:9])), (5, "lead in " + " ".join(w)), (6, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(w)), (10, ""), (11, None)], "item_id long, text string")
    stretches = leaks.near_leaks(df, items).collect()
    got = {r.doc_id: r for r in stretches}
    assert set(got) == {1, 2, 5} and not rows(leaks.leaks(df.where("doc_id = 1"), items))
    assert got[1].item_to - got[1].item_from >= 35 and min(r.item_from for r in stretches if r.doc_id == 2) == 0 and (got[5].item_from, got[5].item_to, got[5].n_terms) == (0, 39, 39)
    assert rows(leaks.near_leaks(df.limit(0), items)) == [] == rows(leaks.near_leaks(df, items.limit(0)))


# --- 9: stuffed pages ---------------------------------------------------------------------------------------

# Fixed texts: prose, a recipe, a program and stuffing that must be told apart without word lists.
PROSE = {
    'ru': 'Вчера вечером мы с друзьями пошли гулять по набережной. Погода была тёплая, и на улице было много людей. Один музыкант играл на гитаре старую песню, которую я слышал ещё в детстве. Мы остановились и слушали его почти полчаса, потому что он пел очень хорошо. Потом начался дождь, и нам пришлось бежать к метро. Домой я вернулся поздно, но день мне очень понравился.',
    'ar': 'ذهبت أمس مع أصدقائي إلى السوق القديم في وسط المدينة. كان الجو جميلا وكانت الشوارع مليئة بالناس. اشترينا بعض الفواكه والخضروات من بائع كبير في السن، وحدثنا عن حياته قبل أن تأتي السيارات إلى المدينة. بعد ذلك جلسنا في مقهى صغير وشربنا الشاي. عندما غربت الشمس عدنا إلى البيت مشيا على الأقدام، وكان الجميع سعداء بهذا اليوم.',
    'ko': '저는 어제 친구와 함께 서울에 있는 오래된 시장에 갔습니다. 날씨가 매우 좋아서 사람들이 많이 있었습니다. 우리는 작은 식당에서 점심을 먹고 나서 강가를 따라 오랫동안 걸었습니다. 저녁이 되자 바람이 조금 불기 시작했지만 춥지는 않았습니다. 집에 돌아와서 어머니께 그날 있었던 일을 이야기해 드렸습니다. 어머니는 웃으시면서 다음에는 함께 가자고 말씀하셨습니다.',
    'zh': '昨天晚上我和朋友们一起去河边散步。天气很好，街上有很多人。有一位老人在桥下拉二胡，我们站在那里听了很久。后来下起了小雨，我们只好跑到附近的咖啡馆躲雨。老板给我们讲了这座城市以前的故事，大家都听得很入迷。回家的时候已经很晚了，但是我觉得这一天过得非常愉快。',
    'hi': 'कल शाम मैं अपने दोस्तों के साथ नदी के किनारे घूमने गया था। मौसम बहुत अच्छा था और वहाँ बहुत से लोग थे। एक बूढ़ा आदमी पुल के नीचे बैठकर बाँसुरी बजा रहा था और हम लोग देर तक उसे सुनते रहे। फिर अचानक बारिश होने लगी, इसलिए हमें पास की एक दुकान में जाना पड़ा। दुकानदार ने हमें चाय पिलाई और शहर की पुरानी कहानियाँ सुनाईं।',
    'vi': 'Tối hôm qua tôi cùng bạn bè đi dạo bên bờ sông. Thời tiết rất đẹp và trên đường có nhiều người. Một ông lão ngồi dưới chân cầu thổi sáo, chúng tôi đứng nghe rất lâu. Sau đó trời bắt đầu mưa nên chúng tôi phải chạy vào một quán cà phê gần đó. Chủ quán kể cho chúng tôi nghe về thành phố này ngày xưa, ai cũng thích thú. Khi về đến nhà thì đã khuya nhưng tôi thấy rất vui.',
    'el': 'Χθες το βράδυ πήγαμε με τους φίλους μου μια βόλτα δίπλα στο ποτάμι. Ο καιρός ήταν πολύ καλός και στους δρόμους υπήρχε πολύς κόσμος. Ένας γέρος καθόταν κάτω από τη γέφυρα και έπαιζε βιολί, και εμείς σταθήκαμε να τον ακούσουμε για πολλή ώρα. Μετά άρχισε να βρέχει και έπρεπε να τρέξουμε σε ένα καφενείο. Ο ιδιοκτήτης μας είπε ιστορίες για την πόλη όπως ήταν παλιά.',
    'tr': 'Dün akşam arkadaşlarımla nehir kenarında yürüyüşe çıktık. Hava çok güzeldi ve sokaklarda birçok insan vardı. Köprünün altında oturan yaşlı bir adam keman çalıyordu, uzun süre durup onu dinledik. Sonra yağmur başladı ve yakındaki bir kahveye sığınmak zorunda kaldık. Kahvenin sahibi bize şehrin eski günlerini anlattı. Eve geç döndüm ama o gün çok mutluydum.',
    'pl': 'Wczoraj wieczorem poszliśmy z przyjaciółmi na spacer nad rzekę. Pogoda była bardzo ładna i na ulicach było dużo ludzi. Starszy pan siedział pod mostem i grał na skrzypcach, a my staliśmy i słuchaliśmy go przez długi czas. Potem zaczął padać deszcz, więc musieliśmy schować się w kawiarni. Właściciel opowiedział nam o dawnych czasach tego miasta.',
    'en': 'Yesterday evening we went for a walk along the river with some friends. The weather was lovely and the streets were full of people. An old man sat under the bridge and played the violin, and we stood there listening to him for a long time. Then it began to rain, so we had to run to a small cafe nearby. The owner told us stories about the town as it was in the old days.',
    'th': 'เมื่อวานนี้ผมไปเดินเล่นริมแม่น้ำกับเพื่อน อากาศดีมากและมีคนเยอะแยะ ชายชราคนหนึ่งนั่งเล่นดนตรีอยู่ใต้สะพาน พวกเราหยุดฟังอยู่นาน แล้วฝนก็เริ่มตก เราจึงวิ่งเข้าไปในร้านกาแฟใกล้ๆ เจ้าของร้านเล่าเรื่องเมืองเก่าให้เราฟัง',
}
ORDINARY = {
    "recipe": 'Carrot cake\n200 g plain flour\n180 g brown sugar\n3 large eggs\n250 g grated carrots\n150 ml sunflower oil\n1 tsp baking soda\n1 tsp ground cinnamon\n1/2 tsp nutmeg\n100 g chopped walnuts\npinch of salt\nFor the frosting\n200 g cream cheese\n50 g soft butter\n100 g icing sugar\n1 tsp vanilla extract',
    "program": 'import os\nimport sys\n\nclass Reader:\n    def __init__(self, path, size=10):\n        self.path = path\n        self.size = size\n\n    def read(self):\n        rows = []\n        with open(self.path) as f:\n            for line in f:\n                line = line.strip()\n                if not line:\n                    continue\n                rows.append(line.split(","))\n        return rows\n\ndef main():\n    reader = Reader(sys.argv[1])\n    for row in reader.read():\n        print(row)\n\nif __name__ == "__main__":\n    main()\n',
}
STUFFED = {
    "function words": "Buy cheap loans from us, get cheap loans for you and your cheap loans with us. " * 12,
    "Russian": "купить диван дешево, диван цена, диван распродажа, диван москва, купить кресло дешево, кресло цена, " * 6,
    "Chinese": "便宜贷款,快速贷款,网上贷款,贷款利率,贷款公司," * 12,
    "distinct products": 'sofa, lamp, carpet, mirror, curtain, table, chair, bench, shelf, drawer, wardrobe, cushion, blanket, pillow, mattress, stool, desk, bookcase, cabinet, sideboard, ottoman, rug, vase, clock, candle, frame, basket, planter, tray, hammock, parasol',
    "distinct words": 'sofa lamp carpet mirror curtain table chair bench shelf drawer wardrobe cushion blanket pillow mattress stool desk bookcase cabinet sideboard ottoman rug vase clock candle frame basket planter tray hammock parasol sofa bed corner garden office discount sale outlet shop store online cheap best price offer deal voucher coupon',
    "products with prices": "".join(f"Lamp Nano {i}.0 SKU-{7 * i} {i}.99 USD / Desk Large {i}.1 offer SKU-{9 * i} {i}.49 USD / " for i in range(12)),
    "links in capitals": "".join(f"[URL=HTTPS://WWW.L{i}.EXAMPLE/A{i}]CHEAP LAMP[/URL]\n" for i in range(12)),
}


@pytest.mark.parametrize("known", [(), ("the", "of", "and", "to", "in", "a", "der", "die", "la", "de")])
def test_stuffing_in_any_language(known):
    for name, text in (PROSE | ORDINARY).items():
        assert stuffing.stuffed(text, known)[1] == 0, name
    for name, text in STUFFED.items():
        n, m, _ = stuffing.stuffed(text, known)
        assert m > 0.6 * n, name


def test_a_repeated_sentence_is_no_keyword():
    text = SENTENCE.format(1) * 8
    assert stuffing.stuffed(text)[1] == 0 and stuffing.stuffed(text, ("the", "and", "that"))[1] == 0


def test_repetition_convicts_alone():
    """With every word known as a function word, recurrence and autocorrelation still tell."""
    text = STUFFED["function words"]
    assert stuffing.stuffed(text, text.lower().replace(",", " ").replace(".", " ").split())[1] > 100
    alternating = " ".join(f"w{i} the of and" for i in range(60))  # no word of it recurs alone but in a fixed beat
    assert stuffing.stuffed(alternating, ["the", "of", "and"])[2] > 0.7


def test_function_words_are_learned(spark):
    docs = [(i, f"The lamp {i} is on the table and of no use to anyone, number {i}.", "en") for i in range(40)]
    docs += [(100 + i, f"Die Lampe steht und der Tisch {i} sieht die Lampe an.", "de") for i in range(25)]
    docs += [(200, "sofa " * 5000, "en"), (201, "sofa " * 5000, "en"), (300, "el la los", "es"), (301, None, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = set(stuffing.function_words(df))
    assert {"the", "on", "and", "of", "die", "und"} <= got and not {"sofa", "el", "la", "table1"} & got
    assert stuffing.function_words(df.limit(0)) == [] and stuffing.function_words(df.drop("lang").limit(3)) == []


SENTENCE = "The provider answered within {} hours and admitted that the price sheet was slow, because nobody in the team had looked at it for a week. "


@pytest.mark.parametrize(
    "text,found",
    [
        (", ".join(["buy Maeshem", "best maeshem 3.1", "cheap maeshem near me"] * 12), True),
        ("\n".join(f"{i}. best Skodark - https://x{i}.example/a/b" for i in range(30)), True),
        (" ".join(f"#tag_{w}_now" for w in "abcdefghijklmnopqrstuvwxyz"), True),
        ("Order best Foo, cheap Foo. Get Foo now! Foo? Yes, cheap Foo! Buy Foo online. " * 8, True),
        ("".join(SENTENCE.format(i) for i in range(12)), False),
        ("".join(SENTENCE.format(i) for i in range(9)) + "\nTags: a, b, c, d, e, f\n" + "\n".join(f"- https://l{i}.example" for i in range(6)), False),
        ("```\n" + "buy foo cheap foo\n" * 40 + "```\n" + SENTENCE.format(1), False),
        ("".join(SENTENCE.format(i) for i in range(4)) + "| a | b |\n" + "| foo 1.0 | 2.50 |\n" * 40, False),
        ("版5.0では画像と音声を同時に送れます。同期のあとで同じモデルが二回表示されました。" * 3, False),
        ("", False), (None, False), ("word", False), ("word " * 100_000, True),
    ],
)
def test_stuffing(text, found):
    n, stuffed, _ = stuffing.stuffed(text)
    assert (stuffed > stuffing.MOST_STUFFED * n) == found


def test_stuffed_pages(spark, rows):
    spam = "cheap foo best foo buy foo online foo " * 20
    docs = [(1, spam, 0.0), (1, spam, 0.0), (2, SENTENCE * 5, 0.0), (3, None, 0.0), (None, spam, 0.0), (4, "", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, correlation double")
    assert rows(stuffing.stuffed_pages(df)) == [(1,)]
    assert rows(stuffing.stuffed_pages(df.limit(0))) == []
    assert stuffing.stuffing(df).count() == 6


# --- 8: mixing --------------------------------------------------------------------------------------------------


def test_mixing(spark, rows):
    docs = [(i, f"some words of text number {i} " * (1 + i % 5), "a" if i < 80 else "b" if i < 95 else "c" if i < 99 else None) for i in range(100)] + [(200, None, "a"), (201, "", "a"), (None, "x", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("key", "rest", "before")})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("d", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats long")
    chosen, shares = mixing.mix(df, targets)
    by = {r.source: r for r in shares.collect()}
    most = {"a": 1, "b": 4, "c": 2}
    got = chosen.collect()
    assert len(got) == len({r.doc_id for r in got}) and all(r.repeats <= most[r.source] for r in got)
    total = sum(r.n_tokens * r.repeats for r in got)
    largest = max(r.n_tokens for r in got)
    for s, r in by.items():
        assert r.mixed_tokens == sum(x.n_tokens * x.repeats for x in got if x.source == s)
        assert r.actual_share == pytest.approx(r.mixed_tokens / total)
        if not r.short_tokens:
            assert r.budget_tokens - largest < r.mixed_tokens <= r.budget_tokens
        else:
            assert r.mixed_tokens == r.available_tokens * r.max_repeats
    assert by["d"].mixed_tokens == 0 and by["d"].short_tokens == by["d"].budget_tokens
    again, _ = mixing.mix(df, targets)
    assert rows(again) == rows(chosen)
    assert rows(mixing.mix(df.limit(0), targets)[0]) == [] and rows(mixing.mix(df, targets.limit(0))[1]) == []


# --- 2: entities ---------------------------------------------------------------------------------------------------


def test_reading_offers(names):
    o = read_offer("MECHALT NANO 10P4 123 BILLION EXPERIMENTAL | monthly plan", names)
    assert (o.family, o.variant, o.version, o.size, o.modifiers) == ("mechalt", "nano", "10.4", "123", "exp")
    o = read_offer("gladraed-large-9-1-72b-vis.-prev@20250610", names)
    assert (o.version, o.size, o.modifiers) == ("9.1", "72", "preview,vision")
    assert read_offer(None, names).family == "" and read_offer("", names).family == ""
    m = read_model("gladraed-large-73-34b", "Gladraed Large 7.3 34B (Chat)", "", "", "", names)
    assert (m.version, m.size, m.modifiers) == ("7.3", "34", "chat")
    assert Vendors(PROVIDERS).find("Tcahuvas Compute GmbH") == ["tachuvas-compute"] == Vendors(PROVIDERS).find("tachuvas.example")
    assert Vendors(PROVIDERS).find(None) == [] == Vendors(PROVIDERS).find("whoever")
    assert read_context("125K ctx") == 125_000 and read_context("65,536 tokens") == 65_536 and read_context(None) is None
    assert read_price("0.003 per 1K") == pytest.approx(3.0) and read_price("$0.60 / 1M in") == 0.6
    assert read_month("22.06.2024") == "2024-06" == read_month("Jun 2024") == read_month("2024-06-03") and read_month("soon") is None


MODEL = "row_id long, model_id string, provider string, display_name string, raw_family string, family string, variant string, version string, context_window long, cost_input double, release_date string"
LISTING = "listing_id long, title string, vendor_name string, family_hint string, context_text string, price_text string, released string"


def tables(spark, models, listings):
    fam = spark.createDataFrame(ENTRIES, "ref_id long, family string, variant string, canonical_provider string")
    return spark.createDataFrame(listings, LISTING), spark.createDataFrame(models, MODEL), fam, spark.createDataFrame([(p,) for p in PROVIDERS], "provider string")


def test_matching_offers(spark, rows):
    m = lambda i, ident, provider="zikria", context=1000: (i, ident, provider, ident, "", "", "", "", context, 1.0, "2024-06-01")
    models = [
        m(1, "gladraed-large-9.1-72b-vision"), m(2, "gladraed-large-9.1-34b-vision"), m(3, "gladraed-large-9.1-72b"), m(4, "fistin-2-7b"), m(5, "fistin-2-7b"),
        m(6, "fistin-2-7b", "sofeiv-ai"), m(7, None), m(8, "mechalt-nano-33-8b", context=None), (9, None, None, None, None, None, None, None, None, None, None),
    ]
    o = lambda i, title, vendor="Zikria": (i, title, vendor, None, None, None, None)
    listings = [
        o(101, "Vision Gladrade Large 9P1 72 B"), o(102, "gladraed large 9.1 vis."), o(103, "fistin 2"), o(104, "Fistin 2 7B hosted", "Sofeiv AI Ltd"), o(105, "gladraed large 9.2 72b vision"),
        o(106, "fistin 2 7b", None), o(107, None), o(108, ""), o(109, "mechalt nano 3.3 8b"), o(110, "fistin 2 7b " + "x " * 20_000), o(103, "fistin 2"), o(111, "fistin 2 7b", "nobody"),
        o(None, "fistin 2"),
    ]
    got = rows(entities.match_offers(*tables(spark, models, listings)).select("listing_id", "row_id"))
    assert got == [(101, 1), (103, 4), (104, 6), (109, 8), (110, 4)]
    empty = tables(spark, models, listings)
    assert rows(entities.match_offers(empty[0].limit(0), *empty[1:])) == [] == rows(entities.match_offers(empty[0], empty[1].limit(0), *empty[2:]))


def exact_beliefs(pairs):
    """Marginals of the same factors by enumerating all settings."""
    offers, classes = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    weight = {(a, b): np.exp(w) for a, b, w in pairs}
    total, mass = 0.0, Counter()

    def walk(k, chosen, product):
        nonlocal total
        if k == len(offers):
            used = Counter(c for c in chosen.values() if c is not None)
            p = product * np.prod([entities.REUSE ** (n - 1) for n in used.values()])
            total += p
            for o, c in chosen.items():
                if c is not None:
                    mass[(o, c)] += p
            return
        walk(k + 1, chosen | {offers[k]: None}, product)
        for c in classes:
            if (offers[k], c) in weight:
                walk(k + 1, chosen | {offers[k]: c}, product * weight[(offers[k], c)])

    walk(0, {}, 1.0)
    return {k: v / total for k, v in mass.items()}


def test_beliefs_are_exact_on_trees(spark):
    pairs = [(1, 10, 2.0), (1, 11, 1.0), (2, 11, 1.5), (3, 12, -1.0), (4, 10, 0.5)]
    df = spark.createDataFrame(pairs, "listing_id long, class_id long, weight double")
    got = {(r.listing_id, r.class_id): r.belief for r in entities.propagate(df).collect()}
    for k, v in exact_beliefs(pairs).items():
        assert got[k] == pytest.approx(v, abs=2e-3)


def test_beliefs_on_circles_settle(spark):
    """Two offers that fit two classes alike, a third that claims one: messages go round and still settle."""
    pairs = [(1, 10, 3.0), (1, 11, 3.0), (2, 10, 3.0), (2, 11, 3.0), (3, 10, 6.0)]
    df = spark.createDataFrame(pairs, "listing_id long, class_id long, weight double")
    got = entities.propagate(df).collect()
    assert all(r.residual < entities.SETTLED for r in got)
    exact = exact_beliefs(pairs)
    assert all(abs(r.belief - exact[(r.listing_id, r.class_id)]) < 0.1 for r in got)
    assert any(r.residual >= entities.SETTLED for r in entities.propagate(df, rounds=1).collect())


def test_propagation_decides(spark, rows):
    """An offer that fits two rows alike goes to the one that no other offer claims; nothing but the messages tells."""
    m = lambda i, ident: (i, ident, "zikria", ident, "fistin", "fistin", "", ident.split("-")[1], 1000, 1.0, "2024-06-01")
    o = lambda i, title: (i, title, "Zikria", None, None, None, None)
    t = tables(spark, [m(1, "fistin-1.12-7b"), m(2, "fistin-11.2-7b")], [o(101, "fistin 112 7b"), o(102, "Fistin 1.12 7B")])
    alone = tables(spark, [m(1, "fistin-1.12-7b"), m(2, "fistin-11.2-7b")], [o(101, "fistin 112 7b")])
    assert rows(entities.match_offers(*t).select("listing_id", "row_id")) == [(101, 2), (102, 1)]
    b = {r.row_id: r.belief for r in entities.pair_beliefs(*alone).collect()}
    assert b[1] == pytest.approx(b[2]) and b[1] < 0.5 and rows(entities.match_offers(*alone)) == []


def test_a_hot_block_is_spread(spark, rows, monkeypatch):
    rng = random.Random(3)
    m = lambda i: (i, f"fistin-{i % 4}b", "zikria", None, "fistin", "fistin", "", "", 1000, 1.0, None)
    o = lambda i: (100 + i, f"fistin {rng.randrange(5)}b", "Zikria", None, None, None, None)
    t = tables(spark, [m(i) for i in range(1, 30)], [o(i) for i in range(60)])
    plain = rows(entities.match_offers(*t).select("listing_id", "row_id"))
    monkeypatch.setattr(skew.salted_join, "__defaults__", ("inner", 5, 4))
    assert rows(entities.match_offers(*t).select("listing_id", "row_id")) == plain and len(plain) > 30


def test_matching_held_out(spark):
    """Offers typed from known rows in other spellings: how many are matched, and how many of these rightly."""
    rng = random.Random(11)
    mods = {"vision": ["vision", "vis."], "preview": ["preview", "prev", "(Preview)"], "exp": ["exp", "experimental"], "chat": ["chat"]}
    models, truth, listings = [], {}, []
    seen = set()
    while len(models) < 90:
        (f, v), version, size, chosen, p = rng.choice(FAMILIES), f"{rng.randrange(1, 10)}.{rng.randrange(1, 10)}", rng.choice(["7", "72", "0.6", "405"]), rng.sample(sorted(mods), rng.randrange(3)), rng.choice(PROVIDERS)
        key = (f, v, version, size, tuple(sorted(chosen)), p)
        if key in seen:
            continue
        seen.add(key)
        i = len(models) + 1
        ident = "-".join(filter(None, [f, v, version, f"{size}b", *chosen]))
        models.append((i, ident, p, ident.replace("-", " ").title(), "", "", "", "", 1000, 1.0, "2024-06-01"))
        words_ = [typo(rng, f) if rng.random() < 0.5 else f, v, rng.choice([version, "v" + version, version.replace(".", "p"), version.replace(".", "-")]), rng.choice([f"{size}b", f"{size} B", f"{size} billion"]), *[rng.choice(mods[m]) for m in chosen]]
        words_ = [w for w in words_ if w]
        rng.shuffle(words_)
        typed = rng.choice([str.upper, str.title, str])(" ".join(words_)) + rng.choice(["", " | hosted", " (API access)"])
        vendor = rng.choice([p, p.title(), p.split("-")[0] + ".example", typo(rng, p)])
        listings.append((1000 + i, typed, vendor, None, None, None, None))
        truth[1000 + i] = i
        # The same offer in a version that nobody has.
        listings.append((5000 + i, typed.replace(words_[0], words_[0]) + " 99.9", "nobody at all", None, None, None, None))
    got = {r.listing_id: r.row_id for r in entities.match_offers(*tables(spark, models, listings)).collect()}
    right = sum(truth.get(k) == v for k, v in got.items())
    assert right >= 0.9 * len(truth) and right >= 0.97 * len(got)
