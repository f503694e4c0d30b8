"""Languages: their function words, scripts, and the notations of language labels."""

from __future__ import annotations

import re

# Frequent function words, by ISO 639-1 code.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this from have or had by but not what all were when we there can an your which their if do will each about how up out them then she many some so these would other into has more her two like him see could no than been its who now my over did down only way may any after also with i a you me our just too very got get am had again before",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir mein meine mir mich uns kein keine sehr schon wieder wenn damit dem im beim etwa hier gut alles ihr ihn dann doch",
    "fr": "le la les de des du et est un une en que qui dans pour pas sur plus par ne ce se au avec il elle sont je nous vous mais ou où son sa ses leur on tout cette ces été être fait comme si même aux très bien j l d c n s qu m t y a ont mon ma mes me moi sans donc chez encore après avant ensuite toutes tous",
    "es": "el la los las de del y es un una en que por para con no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho mi he ha fue lo nada nadie después",
    "pt": "o a os as de do da dos das e é um uma em que por para com não se seu sua ao aos na no nas nos mais mas como foi ele ela são eu me meu minha já muito também só pelo pela até isso isto quando sem este esta depois nem lhe nós ainda você está tem ter ser à às bem mesmo num numa antes outra vez nada ninguém",
    "it": "il lo la i gli le di del della dei delle e è un una uno in che per con non si su al alla ma come più anche sono questo questa da dal dalla nel nella ho ha mi ci ne mio mia se quando molto già stato stata essere cui dove poi dopo prima perché tutto tutti ancora senza io noi quello quella nessuno niente altro c l d",
    "nl": "de het een en van in is dat op te met voor niet zijn er aan ook als door maar om naar bij uit nog dan over wel ik we wij mijn je ze hij zij heeft hebben had was werd worden deze dit die geen meer veel heel na zo al of toen toch weer ons onze hun goed alles niets niemand echt nu kan",
    "ru": "и в не на я что он с это а как то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот мой моя наш очень мои при никто",
    "zh": "的 了 是 我 不 在 有 和 就 人 都 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 这 那 他 她 它 们 把 被 让 给 从 吗 呢 吧",
}

# Names under which a label may mean a language, beside its codes.
NAMES = {
    "en": "en eng english anglais englisch inglés inglese inglês engels английский 英语 英文",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão duits немецкий 德语 德文",
    "fr": "fr fra fre french français francais französisch francés francese francês frans французский 法语 法文",
    "es": "es spa spanish español espanol castellano espagnol spanisch spagnolo espanhol spaans испанский 西班牙语",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese portugees португальский 葡萄牙语",
    "it": "it ita italian italiano italien italienisch italiaans итальянский 意大利语",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch neerlandés olandese holandês нидерландский 荷兰语",
    "ru": "ru rus russian русский russisch russe ruso russo 俄语 俄文",
    "zh": "zh zho chi cmn chinese 中文 汉语 普通话 mandarin chinesisch chinois chino cinese chinês chinees китайский zh-hans zh-hant",
    "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어",
    "bg": "bg bul bulgarian български",
    "pl": "pl pol polish polski",
    "uk": "uk ukr ukrainian українська",
    "sv": "sv swe swedish svenska",
    "da": "da dan danish dansk",
    "no": "no nor nb nob nn nno norwegian norsk",
    "fi": "fi fin finnish suomi",
    "cs": "cs ces cze czech čeština",
    "tr": "tr tur turkish türkçe",
    "ca": "ca cat catalan català",
    "ro": "ro ron rum romanian română",
    "el": "el ell gre greek ελληνικά",
    "ar": "ar ara arabic العربية",
    "hi": "hi hin hindi हिन्दी",
}

LANGUAGES = tuple(FUNCTION_WORDS)
LEXICON: dict[str, frozenset[str]] = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()}
HAN = re.compile(r"[㐀-䶿一-鿿]")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
WORD = re.compile(r"[^\W\d_]+")


def named_language(label: str | None) -> str | None:
    """The ISO 639-1 code that a label names (codes of two or three letters, with or without region or script, or a name), else None."""
    if not isinstance(label, str):
        return None
    plain = label.strip().lower().replace("_", "-")
    return _BY_NAME.get(plain) or _BY_NAME.get(re.split(r"[-.@\s(]", plain, maxsplit=1)[0])


def guess(text: str) -> tuple[str | None, int]:
    """(language, evidence) by script and function words; None where nothing speaks for any."""
    words = [w.lower() for w in WORD.findall(HAN.sub(" ", text))]
    han, cyrillic = len(HAN.findall(text)), sum(1 for w in words if CYRILLIC.match(w))
    latin = [w for w in words if not CYRILLIC.match(w)]
    scores = {k: sum(w in lex for w in latin) for k, lex in LEXICON.items() if k not in ("ru", "zh")}
    best = max(scores, key=scores.get)
    scores = {"zh": han / 2, "ru": cyrillic, best: scores[best] + 0.01 * len(latin) if latin else 0}
    top = max(scores, key=scores.get)
    return (top, int(scores[top] + 0.99)) if scores[top] > 0.5 else (None, 0)
