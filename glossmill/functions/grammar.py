"""Grammar of the four target languages as expressions: gender, plural, articles, lemmas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import SPACE, capitalise_first_letter, trim_all

# Word lists and endings of the rules.
STRESSED_A = ["agua", "águila", "aguila", "alma", "ala", "arma", "arpa", "ave", "área", "area", "aula", "hacha", "hada", "habla", "hambre", "ancla", "asma", "acta", "aspa", "ánfora", "anfora", "áncora", "ancora", "aya", "haba", "asa"]
ASPIRATED_H = ["hache", "haie", "haine", "hall", "halle", "halte", "hamac", "hameau", "hamster", "hanche", "handicap", "hangar", "hareng", "hargne", "haricot", "harnais", "harpe", "hasard", "hâte", "hausse", "haut", "hauteur", "havre", "hérisson", "hernie", "héron", "héros", "hêtre", "hibou", "hiérarchie", "hochet", "hockey", "homard", "honte", "hoquet", "horde", "hors", "hotte", "houle", "housse", "hublot", "huit", "hurlement", "hutte"]
VOWEL = "[aeiouàâäáåèéêëìíîïòóôöøùúûü]"
FEMININE, MASCULINE = "(a|ción|sión|dad|tad|tud|umbre|ie|ez|sis|itis)$", "(o|or|aje|án|ambre|ete|és|ín|ma)$"
IRREGULAR = {"am": "be", "are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "being": "be", "did": "do", "does": "do", "done": "do", "had": "have", "has": "have", "having": "have", "went": "go", "gone": "go", "made": "make", "said": "say", "saw": "see", "seen": "see", "took": "take", "taken": "take", "thought": "think", "knew": "know", "known": "know"}
PRONOUNS = "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves who whom whose which that this these those one ones everyone someone anyone nobody somebody anybody nothing something anything everything".split()


def drop_last(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - n)


def strip_spanish_article(x: Column) -> Column:
    return F.regexp_replace(x, r"^(?i:el|la|los|las|un|una|unos|unas)(?: |$)", "")


def infer_gender(target: Column, known: Column | None = None) -> Column:
    """Known gender, else by the Spanish article, else by the ending of the head word, feminine endings first."""
    low = F.lower(target)
    head = F.split(F.lower(strip_spanish_article(target)), " ")[0]
    by_rule = F.when(low.rlike("^(el|un|los|unos)( |$)"), "masculine").when(low.rlike("^(la|una|las|unas)( |$)"), "feminine").when(head.rlike(FEMININE), "feminine").when(head.rlike(MASCULINE), "masculine")
    return by_rule if known is None else F.coalesce(known, by_rule)


def spanish_plural(target: Column, known: Column | None = None) -> Column:
    """Plural of the first word: z to ces, vowel and s, else es; the other words stay."""
    bare = strip_spanish_article(target)
    head, rest = F.regexp_extract(bare, "^[^ ]*", 0), F.regexp_extract(bare, "^[^ ]*(.*)$", 1)
    made = F.when(head.endswith("z"), F.concat(drop_last(head, 1), F.lit("ces"))).when(F.lower(F.right(head, F.lit(1))).rlike("[aeiouáéíóúü]"), F.concat(head, F.lit("s"))).otherwise(F.concat(head, F.lit("es")))
    out = F.when(bare != "", F.concat(made, rest))
    return out if known is None else F.coalesce(known, out)


def derived_plural(lang: Column, target: Column, gender: Column, german: Column | None = None) -> Column:
    """Plural of a one-word noun by language; German only as looked up; null for several words."""
    low = F.lower(target)
    last, accent = F.right(low, F.lit(1)), F.translate(F.substring(low, F.length(low) - 1, F.lit(1)), "áéíóú", "aeiou")
    es = F.when(low.rlike("[áéíóú]n$"), F.concat(drop_last(target, 2), accent, F.lit("nes"))).when(last == "z", F.concat(drop_last(target, 1), F.lit("ces"))).when(last.isin("s", "x"), target).when(last.rlike("[aeiouáéíóú]"), F.concat(target, F.lit("s"))).otherwise(F.concat(target, F.lit("es")))
    fr = F.when(last.isin("s", "x", "z"), target).when(low.endswith("al") & (F.length(target) > 2), F.concat(drop_last(target, 2), F.lit("aux"))).when(low.rlike("(eau|au|eu)$"), F.concat(target, F.lit("x"))).otherwise(F.concat(target, F.lit("s")))
    it = F.when(last.isin("o", "e"), F.concat(drop_last(target, 1), F.lit("i"))).when(last == "a", F.concat(drop_last(target, 1), F.when(gender == "masculine", "i").otherwise("e"))).otherwise(target)
    out = F.when(lang == "es", es).when(lang == "fr", fr).when(lang == "it", it)
    if german is not None:
        out = out.when(lang == "de", german)
    return F.when(~target.contains(" ") & (target != ""), out)


def fix_spanish_plural(target: Column, plural: Column) -> Column:
    """Repairs: a phrase with "de" inflects its head only; a final stressed vowel loses its accent; -sis stays.

    The accent stays on í or ú after a vowel. Order: phrase, accent, then one word in -sis or -xis.
    """
    link = r"^(.*?)(\sde\s|\sdel\s|\sde la\s|\sde los\s|\sde las\s)(.*)$"
    both = target.rlike(link) & plural.rlike(link)
    phrase = F.when(both, F.concat(F.regexp_extract(plural, link, 1), F.regexp_extract(target, link, 2), F.regexp_extract(target, link, 3))).otherwise(plural)
    stressed = r"^(.*.)([áéíóú])([ns])es$"
    hiatus = phrase.rlike(r"[aeiouáéíóúAEIOUÁÉÍÓÚ][íú][ns]es$")
    accent = F.when(phrase.rlike(stressed) & ~hiatus, F.concat(F.regexp_extract(phrase, stressed, 1), F.translate(F.regexp_extract(phrase, stressed, 2), "áéíóú", "aeiou"), F.regexp_extract(phrase, stressed, 3), F.lit("es"))).otherwise(phrase)
    return F.when(~target.contains(" ") & target.rlike("(sis|xis)$"), target).otherwise(accent)


def _first_word(x: Column) -> Column:
    return F.lower(F.split(trim_all(x), f"{SPACE}+")[0])


def article_form(lang: Column, target: Column, plural: Column, gender: Column, is_plural: Column, kind: Column) -> Column:
    """Noun with the article its English one asks for (kind 'definite', 'indefinite' or null for none)."""
    noun = F.when(is_plural, plural).otherwise(target)
    noun = F.when(lang == "de", capitalise_first_letter(noun)).otherwise(noun)
    w, fem, many = _first_word(noun), gender == "feminine", is_plural
    vowel = w.rlike(f"^{VOWEL}")
    el = fem & (w.rlike("^h?[áà]") | w.isin(STRESSED_A))
    elide = F.when(w.startswith("h"), ~w.isin(ASPIRATED_H)).otherwise(vowel)
    semi = w.rlike("^i[aeiouàèéìíòóù]")
    impure = w.rlike("^(z|gn|pn|ps|x|y)|^s[^aeiouàèéìíòóùú]") | semi
    true_vowel = vowel & ~semi
    lit = F.lit
    definite = {
        "es": F.when(many, F.when(fem, "las ").otherwise("los ")).when(el, "el ").when(fem, "la ").otherwise("el "),
        "de": F.when(many | fem, "die ").when(gender == "neuter", "das ").otherwise("der "),
        "fr": F.when(many, "les ").when(elide, "l'").when(fem, "la ").otherwise("le "),
        "it": F.when(many, F.when(fem, "le ").when(true_vowel | impure, "gli ").otherwise("i ")).when(true_vowel, "l'").when(fem, "la ").when(impure, "lo ").otherwise("il "),
    }
    indefinite = {
        "es": F.when(many, F.when(fem, "unas ").otherwise("unos ")).when(el, "un ").when(fem, "una ").otherwise("un "),
        "de": F.when(many, "").when(fem, "eine ").otherwise("ein "),
        "fr": F.when(many, "des ").when(fem, "une ").otherwise("un "),
        "it": F.when(many, "").when(fem, F.when(true_vowel, "un'").otherwise("una ")).when(impure, "uno ").otherwise("un "),
    }
    by = lambda forms: F.when(lang == "es", forms["es"]).when(lang == "de", forms["de"]).when(lang == "fr", forms["fr"]).when(lang == "it", forms["it"]).otherwise(lit(""))
    return F.concat(F.when(kind == "definite", by(definite)).when(kind == "indefinite", by(indefinite)).otherwise(lit("")), noun)


ARTICLE_BEFORE = r"(?:^|\W)((?i:the|an|a))(\s+)$"


def article_before(back: Column, start: Column) -> tuple[Column, Column]:
    """(kind, start with the article) of an English article at the end of the 16 characters before the offset."""
    word = F.lower(F.regexp_extract(back, ARTICLE_BEFORE, 1))
    kind = F.when(word == "the", "definite").when(word != "", "indefinite")
    return kind, start - F.length(word) - F.length(F.regexp_extract(back, ARTICLE_BEFORE, 2))


def singular(word: Column) -> Column:
    """Rules for the singular of an English noun."""
    w = F.lower(word)
    n = F.length(w)
    return F.when(w.endswith("ies") & (n > 4), F.concat(drop_last(w, 3), F.lit("y"))).when(w.endswith("ves") & (n > 4), F.concat(drop_last(w, 3), F.lit("fe"))).when(w.rlike("[sxz]es$"), drop_last(w, 2)).when(w.endswith("s") & (n > 3), drop_last(w, 1)).otherwise(w)


def verb_lemma(word: Column) -> Column:
    """Irregular forms, then rules for the infinitive of an English verb; a doubled last letter before -ing is undone."""
    w = F.lower(word)
    n = F.length(w)
    stem = drop_last(w, 3)
    undone = F.when((n > 4) & (F.right(stem, F.lit(1)) == F.substring(stem, F.length(stem) - 1, F.lit(1))), drop_last(stem, 1)).otherwise(stem)
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])[w]
    return F.coalesce(irregular, F.when(w.endswith("ies") & (n > 4), F.concat(stem, F.lit("y"))).when(w.endswith("ing") & (n > 5), undone).when(w.endswith("ed") & (n > 4), drop_last(w, 2)).when(w.endswith("s") & (n > 3), drop_last(w, 1)).otherwise(w))
