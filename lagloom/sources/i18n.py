"""Languages: header names, date formats, item names and all texts shown to people."""

from __future__ import annotations

import locale
import os

# The header names of diary files, and the canonical column each stands for.
HEADERS = {
    "en": {"date": "date", "time": "time", "meal": "meal", "foods": "foods", "medications": "medications", "sleep": "sleep", "pain": "pain"},
    "fr": {"date": "date", "heure": "time", "repas": "meal", "aliments": "foods", "medicaments": "medications", "sommeil": "sleep", "douleur": "pain"},
}
REQUIRED = ("date", "foods", "pain")
DATE_FORMATS = {
    "en": ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "M.d.yyyy"),
    "fr": ("yyyy-M-d", "d/M/yyyy", "d/M/yy", "d.M.yyyy"),
}
TIME_FORMATS = ("H:mm", "H:mm:ss", "h:mma")
SHORT_DATE = {"en": "M/d/yy", "fr": "dd/MM/yyyy"}

# Names of generated diaries in French.
ITEMS = {
    "fr": {
        "coffee": "cafe", "bread": "pain", "butter": "beurre", "jam": "confiture", "milk": "lait", "cereal": "cereales", "eggs": "oeufs", "banana": "banane",
        "yoghurt": "yaourt", "orange juice": "jus_orange", "rice": "riz", "pasta": "pates", "chicken": "poulet", "beef": "boeuf", "fish": "poisson",
        "vegetables": "legumes", "salad": "salade", "tomato": "tomate", "cheese": "fromage", "potato": "pomme_de_terre", "oil": "huile", "wine": "vin",
        "chocolate": "chocolat", "apple": "pomme", "soup": "soupe", "lentils": "lentilles", "onion": "oignon", "garlic": "ail", "chilli": "piment",
        "prawns": "crevettes", "mushroom": "champignon", "courgette": "courgette", "antacid": "antiacide",
        "breakfast": "petit_dejeuner", "lunch": "dejeuner", "dinner": "diner", "diary": "journal",
    }
}

#: Code -> language -> text; a pair is the text for one and the text for several (``n``).
MESSAGES: dict[str, dict[str, str | tuple[str, str]]] = {
    "bad_date": {"en": "line {line}: unreadable date {arg!r}, row skipped", "fr": "ligne {line} : date illisible {arg!r}, ligne ignorée"},
    "bad_time": {"en": "line {line}: unreadable time {arg!r}, noon taken", "fr": "ligne {line} : heure illisible {arg!r}, midi retenu"},
    "bad_outcome": {"en": "line {line}: unreadable outcome {arg!r}, left out", "fr": "ligne {line} : valeur illisible {arg!r}, ignorée"},
    "default_time": {
        "en": ("{n} row without a time, noon taken", "{n} rows without a time, noon taken"),
        "fr": ("{n} ligne sans heure, midi retenu", "{n} lignes sans heure, midi retenu"),
    },
    "missing_column": {"en": "column {arg!r} is missing", "fr": "colonne {arg!r} absente"},
    "similar_names": {"en": "similar names: {arg}", "fr": "noms proches : {arg}"},
    "no_lines": {"en": "no row can be used", "fr": "aucune ligne utilisable"},
    "no_items": {"en": "no item occurs often enough", "fr": "aucun élément n'est assez fréquent"},
    "no_free_items": {"en": "no item can be told from the controls", "fr": "aucun élément ne se distingue des variables de contrôle"},
    "no_replicates": {"en": "too few readings for resampling", "fr": "trop peu de relevés pour le rééchantillonnage"},
    "no_diary": {"en": "no such diary", "fr": "journal inconnu"},
    "error": {"en": "Error: {arg}", "fr": "Erreur : {arg}"},
    "too_few": {
        "en": "Too few rows: at least 10 readings and 5 entries are needed, here are {n} and {arg}.",
        "fr": "Trop peu de lignes : il faut au moins 10 relevés et 5 prises, il y en a {n} et {arg}.",
    },
    "head": {
        "en": ("{n} day, {readings} readings, {blocks} items or groups, autocorrelation {rho:.2f}", "{n} days, {readings} readings, {blocks} items or groups, autocorrelation {rho:.2f}"),
        "fr": ("{n} jour, {readings} relevés, {blocks} éléments ou groupes, autocorrélation {rho:.2f}", "{n} jours, {readings} relevés, {blocks} éléments ou groupes, autocorrélation {rho:.2f}"),
    },
    "columns": {"en": "item|sure|delay|peak|effect|n", "fr": "élément|sûr|délai|pic|effet|n"},
    "found": {"en": "◆ found in at least {arg} of resamplings", "fr": "◆ retrouvé dans au moins {arg} des rééchantillonnages"},
    "legend": {
        "en": "delay: from intake to the strongest response; peak: its size for one intake; effect: mean share of all readings",
        "fr": "délai : de la prise à la plus forte réponse ; pic : son ampleur pour une prise ; effet : part moyenne de tous les relevés",
    },
    "reliever": {"en": "℞ a reliever: its effect lowers the outcome", "fr": "℞ un soulagement : son effet abaisse la valeur"},
    "together": {"en": "Always together: {arg}", "fr": "Toujours ensemble : {arg}"},
    "regular": {"en": "Too regular to be told from the time of day: {arg}", "fr": "Trop réguliers pour être distingués de l'heure du jour : {arg}"},
    "rare": {"en": "Too rare: {arg}", "fr": "Trop rares : {arg}"},
    "next": {
        "en": "Next: leave out, one at a time, {arg}, for two weeks each. A diary alone proves no cause.",
        "fr": "Ensuite : écarter, un à la fois, {arg}, deux semaines chacun. Un journal seul ne prouve aucune cause.",
    },
    "nothing": {"en": "Nothing stands out yet: a longer or more varied diary may show more.", "fr": "Rien ne ressort encore : un journal plus long ou plus varié en dira plus."},
    "written": {"en": "{arg}: a synthetic diary of {n} days. Its culprits:", "fr": "{arg} : un journal synthétique de {n} jours. Ses coupables :"},
    "culprit": {"en": "  {arg}: delay {lag:g} h, size {size:+g}", "fr": "  {arg} : délai {lag:g} h, ampleur {size:+g}"},
    "quality": {
        "en": "{n} days, {readings:.0f} readings: recall {recall:.0%}, precision {precision:.0%}, delay error {err:.1f} h",
        "fr": "{n} jours, {readings:.0f} relevés : rappel {recall:.0%}, précision {precision:.0%}, erreur de délai {err:.1f} h",
    },
    "format": {
        "en": """A diary is a CSV or ODS file with the columns date, time, meal, foods, medications, pain.
Dates: 2026-08-31, 08/31/2026, 08.31.2026. Times: 08:00, 8:00, 08:00:00, 8:30am; without one, noon is taken.
Several foods or medications in a cell are separated by semicolons. pain is a number, and may be empty.
Readings away from meals, varied meals and honestly missed doses make delays and effects easier to tell.""",
        "fr": """Un journal est un fichier CSV ou ODS avec les colonnes date, heure, repas, aliments, médicaments, douleur.
Dates : 2026-08-31, 31/08/2026, 31.08.2026. Heures : 08:00, 8:00, 08:00:00, 8:30am ; sans heure, midi est retenu.
Plusieurs aliments ou médicaments d'une cellule sont séparés par des points-virgules. douleur est un nombre, ou vide.
Des relevés hors des repas, des repas variés et des oublis notés rendent délais et effets plus lisibles.""",
    },
}


def language(given: str | None = None) -> str:
    """Two-letter language: given, LAGLOOM_LANG, the system's, or English."""
    found = given or os.environ.get("LAGLOOM_LANG") or (locale.getlocale()[0] or "en")
    return found[:2].lower()


def message(code: str, lang: str = "en", **values) -> str:
    """A text in a language, English where it has none; ``n`` chooses between the forms for one and for several."""
    known = MESSAGES[code]
    lang = lang if lang in known else "en"
    text = known[lang]
    if not isinstance(text, str):
        n = float(values["n"])
        text = text[0] if (n < 2 if lang == "fr" else n == 1) else text[1]
    return text.format(**values)


def item_name(name: str, lang: str = "en") -> str:
    """A generator's name in a language, normalised."""
    from ..functions.text import normal_name

    return normal_name(ITEMS.get(lang, {}).get(name, name))
