"""Language of texts and of stretches inside texts by compression.

Each class (a language, Uzbek once per script) has a zstandard raw-content dictionary. A sentence is
compressed with every dictionary; the class whose dictionary leaves the fewest bytes wins. Where the
best two languages are closer than a margin the sentence is rejected and takes the language of the
stretch it stands in.

Dictionaries are made here: a short built-in text per class, and sentences of a bounded sample of
labelled rows. A sentence enters the dictionary of its label if the labels of all its occurrences
agree by majority and dictionaries made of other rows confirm it clearly. All classes get the same
number of bytes, chosen by hash and ordered by certainty, so neither the order of the rows nor the
mix of languages shifts the comparison.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mezon.functions.pytext import APOSTROPHES, INVISIBLE, UZ_CYRILLIC, split_sentences
from mezon.session import spread

#: At most so many labelled rows (an equal part per language), none longer than so many characters, are
#: looked at for the dictionaries. This bounds the fit only; every text is classified whole.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
#: Bytes of sentences per dictionary, the same for every class: what the class with the least has, within these bounds.
LEAST_BYTES, DICT_BYTES = 8 * 1024, 48 * 1024
#: Put before every sentence: without it a short one is often stored as it is, and all sizes are equal.
PAD = b" " * 64
#: A sentence is rejected if the runner-up needs less than this share more bytes, or less than so many bytes more.
MARGIN, MARGIN_BYTES = 0.04, 3

# Names and codes of the languages.
LANGUAGE_NAMES = {
    "uz": "uz uzb uzn uzs uzbek ozbek ozbekcha узбекский ўзбек ўзбекча",
    "en": "en eng english ingliz inglizcha",
    "ru": "ru rus russian русский rus tili ruscha",
    "kk": "kk kaz kazakh qazaq қазақ казахский",
    "tr": "tr tur turkish türkçe turkce türk turk",
}
_CODES = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}

SEEDS = {
    "en": """All human beings are born free and equal in dignity and rights. They are endowed with reason and
conscience and should act towards one another in a spirit of brotherhood. Please tell me what time the shop opens
and how much it will cost. We have received your message and will answer you as soon as possible. Could you help me
with this problem, because it does not work any more? Thank you very much, that was all I wanted to know. They said
that there would be no trains on that day, so we stayed at home and watched a film. I have been waiting for an hour.
Where can I find the form that I have to fill in before Monday? She told us that the meeting had been moved
to another day because the manager was ill. If you do not agree with this decision, you may write to us within two
weeks. There was nothing left in the box when we opened it, although it had been closed. My brother wants to buy a
new phone, but he has not found one that he likes yet. The water in this town is clean, and children often swim in
the river during summer. Would it be possible to pay for both tickets at once? People who live near the station say
that it has become much quieter there. After that he went out without saying which way he would go.""",
    "ru": """Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и
должны поступать в отношении друг друга в духе братства. Скажите, пожалуйста, во сколько открывается магазин и
сколько это будет стоить. Мы получили ваше сообщение и ответим вам как можно скорее. Не могли бы вы мне помочь,
потому что это больше не работает? Большое спасибо, это всё, что я хотел узнать. Нам сказали, что в этот день
поездов не будет, поэтому мы остались дома и смотрели фильм. Я жду уже целый час, но никто не пришёл.
Где можно найти бланк, который нужно заполнить до понедельника? Она сказала, что встречу перенесли на другой
день, потому что начальник заболел. Если вы не согласны с этим решением, напишите нам в течение двух недель. В коробке
ничего не осталось, когда мы её открыли, хотя она была закрыта. Мой брат хочет купить новый телефон, но пока не нашёл
такой, который ему нравится. Вода в этом городе чистая, и дети летом часто купаются в реке. Можно ли сразу оплатить
оба билета? Люди, которые живут рядом с вокзалом, говорят, что там стало намного тише. После этого он вышел и не
сказал, куда пойдёт.""",
    "kk": """Барлық адамдар тумысынан азат және қадір-қасиеті мен құқықтары тең болып дүниеге келеді. Адамдарға
ақыл-парасат, ар-ождан берілген, сондықтан олар бір-бірімен туыстық, бауырмалдық қарым-қатынас жасаулары тиіс.
Дүкен сағат нешеде ашылатынын және бұл қанша тұратынын айтыңызшы. Біз сіздің хабарламаңызды алдық және мүмкіндігінше
тез жауап береміз. Маған көмектесе аласыз ба, өйткені бұл енді жұмыс істемейді? Көп рақмет, білгім келгені осы еді.
Сол күні пойыз болмайды деді, сондықтан біз үйде қалып, кино көрдік. Мен бір сағаттан бері күтіп отырмын.
Дүйсенбіге дейін толтыруым керек парақты қайдан таба аламын? Ол бастық ауырып қалғандықтан кездесу басқа күнге
ауыстырылғанын айтты. Егер бұл шешіммен келіспесеңіз, бізге екі апта ішінде жаза аласыз. Қорапты ашқанымызда, ол жабық
болса да, ішінде ештеңе қалмаған екен. Менің інім жаңа телефон сатып алғысы келеді, бірақ өзіне ұнайтынын әлі тапқан
жоқ. Бұл қаланың суы таза, жазда балалар өзенге жиі шомылады. Екі билеттің ақысын бірден төлеуге бола ма? Вокзалдың
жанында тұратын адамдар ол жердің әлдеқайда тыныш болып кеткенін айтады. Содан кейін ол қайда баратынын айтпай шығып
кетті.""",
    "tr": """Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve
birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Lütfen mağazanın saat kaçta açıldığını ve bunun ne
kadar tutacağını söyleyin. Mesajınızı aldık ve size en kısa zamanda cevap vereceğiz. Bana yardım edebilir misiniz,
çünkü bu artık çalışmıyor? Çok teşekkür ederim, öğrenmek istediğim buydu. O gün tren olmayacağını söylediler, bu
yüzden evde kaldık ve film izledik. Bir saattir bekliyorum ama kimse gelmedi. Daha sonra görüşürüz.
Pazartesiye kadar doldurmam gereken formu nerede bulabilirim? Müdür hasta olduğu için toplantının başka bir güne
alındığını söyledi. Bu karara katılmıyorsanız iki hafta içinde bize yazabilirsiniz. Kutuyu açtığımızda, kapalı olmasına
rağmen içinde hiçbir şey kalmamıştı. Kardeşim yeni bir telefon almak istiyor ama henüz beğendiği bir tane bulamadı. Bu
şehrin suyu temizdir ve çocuklar yazın sık sık nehirde yüzer. İki biletin parasını aynı anda ödemek mümkün mü?
İstasyonun yakınında oturan insanlar oranın çok daha sessiz olduğunu söylüyor. Ondan sonra hangi yöne gideceğini
söylemeden dışarı çıktı.""",
    "uz": """Barcha odamlar erkin, qadr-qimmat va huquqlarda teng bo'lib tug'iladilar. Ular aql va vijdon sohibidirlar
va bir-birlari bilan birodarlarcha muomala qilishlari zarur. Iltimos, do'kon soat nechada ochilishini va bu qancha
turishini ayting. Biz sizning xabaringizni oldik va imkon qadar tez javob beramiz. Menga yordam bera olasizmi, chunki
bu endi ishlamayapti? Katta rahmat, bilmoqchi bo'lganim shu edi. O'sha kuni poyezd bo'lmaydi deyishdi, shuning uchun
biz uyda qolib kino ko'rdik. Men bir soatdan beri kutyapman, lekin hech kim kelmadi. Keyinroq ko'rishamiz.
Dushanbagacha to'ldirishim kerak bo'lgan varaqani qayerdan topsam bo'ladi? U boshliq kasal bo'lib qolgani uchun
yig'ilish boshqa kunga ko'chirilganini aytdi. Agar bu qarorga rozi bo'lmasangiz, ikki hafta ichida bizga yozishingiz
mumkin. Qutini ochganimizda, u yopiq bo'lsa ham, ichida hech narsa qolmagan edi. Ukam yangi telefon sotib olmoqchi, ammo
o'ziga yoqadiganini hali topgani yo'q. Bu shaharning suvi toza, yozda bolalar tez-tez daryoda cho'milishadi. Ikkita
chiptaning pulini birdaniga to'lash mumkinmi? Vokzal yaqinida yashaydigan odamlar u yer ancha tinch bo'lib qolganini
aytishadi. Shundan keyin u qaysi tomonga ketishini aytmasdan chiqib ketdi.""",
}

_TO_CYR = sorted(
    {v: k for k, v in UZ_CYRILLIC.items() if v and k not in "щыэ"} | {"o'": "ў", "g'": "ғ"} | {"ye": "е"},
    key=len, reverse=True,
)
_CYR_OF = {v: k for k, v in UZ_CYRILLIC.items() if v and k not in "щыэўғ"} | {"o'": "ў", "g'": "ғ", "ye": "е", "'": "ъ"}
_LAT = re.compile("|".join(map(re.escape, sorted([*_TO_CYR, "'"], key=len, reverse=True))))
_APOS = re.compile(f"[{APOSTROPHES}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_NOISE = re.compile(r"https?://\S+|\S+@\S+|[\d_]+")
_SPACES = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W\d_]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")


def fold(text: str) -> bytes:
    """What is compressed: lower case, one apostrophe and one space, without numbers, links, addresses and names.

    Names look alike in every language: words with a capital that do not begin the text are left out,
    unless most letters would go with them.
    """
    text = _APOS.sub("'", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))
    all_words = text.split()
    plain = " ".join(w for i, w in enumerate(all_words) if not i or len(w) < 2 or not w[0].isupper())
    if 2 * len(_LETTER.findall(plain)) < len(_LETTER.findall(text)):
        plain = text
    return _SPACES.sub(" ", _NOISE.sub("", plain.lower())).strip().encode()


def to_cyrillic(text: str) -> str:
    """Uzbek Latin letters in Cyrillic, for the dictionary of that script; words keep a leading capital."""

    def word(m: re.Match) -> str:
        w = _LAT.sub(lambda x: _CYR_OF[x[0]], m[0].lower())
        return w[:1].upper() + w[1:] if m[0][0].isupper() else w

    return re.sub(r"[^\W\d_](?:'?[^\W\d_]|')*", word, _APOS.sub("'", text))


def label_language(label: str | None) -> str | None:
    """The language a label names, or None: case, script and region subtags make no difference."""
    first = re.split(r"[-_\s.;,(]", (label or "").strip().lower())[0]
    return _CODES.get(first)


@dataclass
class Model:
    """Dictionaries of the classes; ``classes[i]`` is the language of dictionary i."""

    classes: list[str]
    dictionaries: list[bytes]
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"classes": self.classes, "dictionaries": self.dictionaries, "_compressors": []}

    def sizes(self, folded: bytes) -> list[int]:
        if not self._compressors:
            params = zstandard.ZstdCompressionParameters.from_level(
                12, window_log=17, min_match=3, write_content_size=0, write_dict_id=0
            )
            for raw in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return [len(c.compress(PAD + folded)) for c in self._compressors]

    def score(self, text: str, given: str | None = None) -> tuple[str | None, float]:
        """(language, confidence) of one sentence; None if it has no letters.

        Confidence is the share of bytes that the best other language costs more, from 0 to 1. Where
        that is too narrow, ``given`` is taken if it is as near to the best as the runner-up.
        """
        folded = fold(text)
        if not _LETTER.search(folded.decode()):
            return None, 0.0
        best: dict[str, int] = {}
        for lang, n in zip(self.classes, self.sizes(folded)):
            best[lang] = min(n, best.get(lang, n))
        (lang, a), (_, b) = sorted(best.items(), key=lambda x: (x[1], x[0]))[:2]
        if (b - a < MARGIN_BYTES or b - a < MARGIN * b) and best.get(given) in (a, b):
            lang = given
        if b - a < MARGIN_BYTES:
            return lang, min((b - a) / max(b, 1), MARGIN * 0.99)
        return lang, (b - a) / b

    def stretches(self, text: str | None, given: str | None = None) -> list[tuple[str, float, int, int]]:
        """(language, confidence, first sentence, last sentence) of each longest stretch in one language.

        Rejected sentences join the stretch before them, leading ones the first stretch; if all are
        rejected the whole text is scored at once, and if that is rejected too the language of its
        label (``given``) decides among the nearest two. A text without letters gives none.
        """
        sentences = split_sentences(text)
        scores = [self.score(s) for s in sentences]
        if not any(lang for lang, _ in scores):
            return []
        if not any(c >= MARGIN for _, c in scores):
            lang, c = self.score(" ".join(sentences), given)
            return [(lang, c, 1, len(sentences))]
        out: list[list] = []
        for i, (lang, c) in enumerate(scores, 1):
            if lang is None or c < MARGIN:
                if out:
                    out[-1][3] = i
            elif out and out[-1][0] == lang:
                out[-1][1].append(c)
                out[-1][3] = i
            else:
                out.append([lang, [c], 1 if not out else i, i])
        return [(lang, float(np.mean(c)), a, b) for lang, c, a, b in out]


CLASSES = ("en", "ru", "kk", "tr", "uz", "uz-cyrl")


def _model(sentences: dict[str, dict[bytes, float]]) -> Model:
    """Dictionaries from certainty by folded sentence and class: seeds first, what is most certain nearest to the end."""
    size = {n: sum(len(f) + 2 for f in sentences.get(n, ())) for n in CLASSES}
    budget = min(max(min(size.values()), LEAST_BYTES), DICT_BYTES)
    dictionaries = []
    for name in CLASSES:
        lines = [fold(s) for s in split_sentences(to_cyrillic(SEEDS["uz"]) if name == "uz-cyrl" else SEEDS[name])]
        taken, left = [], budget
        for f in sorted(sentences.get(name, {}), key=lambda f: (xxhash.xxh64_intdigest(f), f)):
            if len(f) + 2 <= left:
                taken.append(f)
                left -= len(f) + 2
        dictionaries.append(b" \n".join(lines + sorted(taken, key=lambda f: (sentences[name][f], f))))
    return Model([n.split("-")[0] for n in CLASSES], dictionaries)


def label_column(label: Column) -> Column:
    """``label_language`` as a column expression."""
    codes = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return codes[F.regexp_extract(F.lower(F.trim(label)), r"^\s*([^-_\s.;,(]*)", 1)]


def train(df: DataFrame, text: str, label: str, key: str | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries from at most ``sample_rows`` labelled rows, as many per language, drawn by a hash of key and text."""
    rows = df.where((F.length(F.trim(F.col(text))) > 0) & (F.length(F.col(text)) <= SAMPLE_CHARS)).select(
        F.col(text).alias("t"), label_column(F.col(label)).alias("l"), F.xxhash64(*([key] if key else []), text).alias("h")
    )
    counts = {r[0]: r[1] for r in rows.where("l IS NOT NULL").groupBy("l").count().collect()}
    each = sample_rows // max(len(LANGUAGE_NAMES), 1)
    # a hash below the language's share is kept, so that hardly more rows are sorted than are wanted
    share = F.create_map(*[F.lit(x) for lang, n in (counts or {"": 1}).items() for x in (lang, min(1.0, 1.25 * each / n))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("l")] * (1 << 20))
    out: list[tuple[str, str]] = []
    for lang in sorted(counts):
        out += [(r[0], lang) for r in drawn.where(F.col("l") == lang).orderBy("h", "t").limit(each).select("t").collect()]
    taken = Counter(lang for _, lang in out)
    return fit(out, {lang: counts[lang] / n for lang, n in taken.items()})


def fit(rows: list[tuple[str, str | None]], weights: dict[str, float] | None = None) -> Model:
    """Dictionaries from (text, label) rows, which may come in any order and repeat; ``weights``: rows that one row of a label stands for.

    Three rounds. In each, a sentence is taken for its row's label if the labels of all rows that hold
    the sentence agree by majority and the dictionaries of the other half of the rows (halves by hash
    of the text; at first the seeds alone) choose that language with at least the margin. A wrong
    label must thus be outvoted or contradicted, and cannot confirm itself.
    """
    known = [(t, label_language(given)) for t, given in rows]
    votes: dict[bytes, Counter] = defaultdict(Counter)
    found: dict[tuple[int, str, bytes], str] = {}
    for t, given in known:
        if given:
            half = xxhash.xxh64_intdigest(t) & 1
            for s in split_sentences(t):
                f = fold(s)
                votes[f][given] += (weights or {}).get(given, 1.0)
                found[half, given, f] = min(s, found.get((half, given, f), s))
    agreed = {k: s for k, s in found.items() if 2 * votes[k[2]][k[1]] > votes[k[2]].total()}
    models = [_model({})] * 2
    for _ in range(3):
        halves: list[dict[str, dict[bytes, float]]] = [{}, {}]
        for (half, given, f), s in agreed.items():
            lang, c = models[1 - half].score(s)
            if lang == given and c >= MARGIN:
                _add(halves[half], lang, s, c)
        models = [_model(h) for h in halves]
    return _model({k: halves[0].get(k, {}) | halves[1].get(k, {}) for k in CLASSES})


def _add(sentences: dict[str, dict[bytes, float]], lang: str, s: str, certainty: float) -> None:
    """Uzbek goes to the class of its script, and from Latin to both."""
    forms = [(lang, fold(s))]
    if lang == "uz":
        cyrillic = len(_CYRILLIC.findall(s)) * 2 > len(_LETTER.findall(s))
        forms = [("uz-cyrl", fold(s))] if cyrillic else [*forms, ("uz-cyrl", fold(to_cyrillic(s)))]
    for name, f in forms:
        known = sentences.setdefault(name, {})
        known[f] = max(certainty, known.get(f, 0.0))


def detect(df: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """Stretches of every text: (``key``, lang_label, label_lang, n_langs, seg_no, lang, confidence, first_sentence, last_sentence).

    ``n_langs`` counts the text's distinct languages. Null, empty and letterless texts give no row.
    Repeated rows give repeated results; the label may be null.
    """
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")))
    kind = rows.schema["k"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            labels = batch.column(2).to_pylist()
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = m.stretches(t, label_language(labels[i]))
                at += [i] * len(found)
                n = len({x[0] for x in found})
                out += [(label_language(labels[i]), n, j, *x) for j, x in enumerate(found, 1)]
            cols = list(zip(*out)) if out else [()] * 7
            idx = pa.array(at, pa.int64())
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(idx), batch.column(2).take(idx), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["k", "lang_label", "label_lang", "n_langs", "seg_no", "lang", "confidence", "first_sentence", "last_sentence"],
            )

    schema = f"k {kind}, lang_label string, label_lang string, n_langs long, seg_no long, lang string, confidence double, first_sentence long, last_sentence long"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
