"""Fixed values of the text cleaner: ordered (pattern, replacement, flags) rules.

Flags: i ignores case, m lets ^ and $ match at lines, 1 replaces the first match only.
"""

#: Fixed values. Unicode normalisation.
UNICODE_RULES = [
    ("[\"\"„]", '"', ""),
    ("[''‛]", "'", ""),
    ("[–—]", "-", ""),
    ("\ufffd", "", ""),
    ("[•·▪▸►◆]", "-", ""),
    ("°[\"'`]", "er ", ""),
    ("£", "e", ""),
    ("©", "c", ""),
    ("n®{s}*([0-9])", "n° $1", ""),
    ("n®{s}*([A-Z])", "n° $1", ""),
    ("{B}([0-9]{1,2})[®™*]+[™*]*{s}*([eéè]tage)", "$1ème $2", "i"),
    ("{B}([0-9]{1,2})\\*[0-9]\\*{s}*([eéè]tage)", "$1ème $2", "i"),
    ("®", "", ""),
    ("™", "", ""),
    ("\\A\ufeff", "", ""),
    ("€(?!{s}*[0-9])", "e", ""),
    ("œ", "oe", ""),
    ("æ", "ae", ""),
    ("Æ", "AE", ""),
    ("Œ", "OE", ""),
]

#: Fixed values. Frequent recognition errors.
ERROR_RULES = [
    ("{B}ler{B}", "1er", "i"),
    ("{B}1°{s}*(?=[a-zA-ZÀ-ÿ])", "1er ", ""),
    ("1°[\"'`]", "1er ", ""),
    ("1°\\\\", "1er ", ""),
    ("({B}Civ\\.?{s}+)1°[\"'\\\\]", "$11er ", "i"),
    ("({B}Cass\\.?{s}+)([0-9])°({s}+civ)", "$1$2e$3", "i"),
    ("{B}([0-9]{1,2})°({s}+arrondissement)", "$1e$2", "i"),
    ("([0-9]{1,2})\"®", "$1e", ""),
    ("([0-9]{1,2})°[\"'\\\\]", "$1e", ""),
    ("([0-9])O([0-9])", "$10$2", ""),
    ("{B}O([0-9]{4,}){B}", "0$1", ""),
    ("([0-9]{4,})O{B}", "$10", ""),
    ("{B}Cedex{s}+O([0-9])", "Cedex 0$1", "i"),
    ("{s}O([0-9])", " 0$1", ""),
    ("([a-zA-ZÀ-ÿ])\"([a-zA-ZÀ-ÿ])", "$1'$2", ""),
    ("-\\n([a-zà-ÿ])", "$1", ""),
    ("de-référ[ée]", "de référé", ""),
    ("n°a{B}", "n'a", ""),
    ("d°(!|[a-zA-ZÀ-ÿ])", "d'$1", ""),
    ("°([a-zA-ZÀ-ÿ]{2,})", "'$1", ""),
    ("°°", "", ""),
    ("gem£\"?t", "gement", ""),
    ("{B}apparait{B}", "apparaît", "i"),
    ("{B}agre[ée]{B}", "agréé", "i"),
    ("{B}ceeans{B}", "céans", "i"),
    ("{B}deceans{B}", "de céans", "i"),
    ("{B}refere{B}", "référé", "i"),
    ("{B}rhuamtologiques?{B}", "rhumatologiques", "i"),
    ("{B}Néañoins{B}", "Néanmoins", ""),
    ("{B}favorablemet{B}", "favorablement", "i"),
    ("{B}pièce{s}+n\\*{s}*([0-9])", "pièce n° $1", "i"),
    ("{B}pièce{s}+n%{s}*([0-9])", "pièce n° $1", "i"),
    ("{B}pièce{s}+n\\^{s}*([0-9])", "pièce n° $1", "i"),
    ("{B}Pièce{s}+ntt([0-9])", "Pièce n° $1", ""),
    ("{B}([0-9]+){s}+E,", "$1 €,", ""),
    ("{B}([0-9]+){s}+E{B}(?![A-Za-z0-9_])", "$1 €", ""),
    ("{B}te{s}+(Juge|jugement|juge){B}", "le $1", "i"),
    ("{B}tes{s}+(demandes|délais|dépens|locaux|lieux|parties|termes|conclusions|frais){B}", "les $1", "i"),
    ("(?<![a-zA-ZÀ-ÿ])ta{s}+(société|somme|saisie|décision|charge|saisies){B}", "la $1", "i"),
    ("{B}artide{B}", "article", ""),
    ("{B}Artide{B}", "Article", ""),
    ("{B}auAence{B}", "audience", ""),
    ("{B}jvge{B}", "juge", ""),
    ("{B}Jvge{B}", "Juge", ""),
    ("{B}préjudee{B}", "préjudice", ""),
    ("{B}irrépetibies{B}", "irrépétibles", ""),
    ("{B}irrépétibies{B}", "irrépétibles", ""),
    ("{B}appEcation{B}", "application", ""),
    ("RECONVERSION{s}+N{s}+ELLE{B}", "RECONVENTIONNELLE", ""),
    ("RECONVENTTONNELS?{B}", "RECONVENTIONNELS", ""),
    ("^Art[»*]+{s}*:{s}*", "", "m1"),
    ("{B}Pièce{s}+i[»?]p([0-9])", "Pièce n° $1", ""),
    ("{B}Pièce{s}+np([0-9])", "Pièce n° $1", ""),
    ("{line_ws}{2,}", " ", ""),
    ("{s}'", "'", ""),
    ("\\t", " ", ""),
]

#: Fixed values. Structure; trimming follows.
STRUCTURE_RULES = [
    ("{line_ws}+([,.;:!?])", "$1", ""),
    ("([.!?])([A-ZÀ-Ö])", "$1 $2", ""),
    ("\\n{3,}", "\n\n", ""),
]

#: Fixed values. The other profile, for exported text files; trimming is not part of it.
EXPORT_RULES = [
    ("\\A\ufeff", "", ""),
    ("\\r\\n", "\n", ""),
    ("\\r", "\n", ""),
    ("[\u2018\u2019]", "'", ""),
    ("[\u201c\u201d\u201e]", '"', ""),
    ("n[®°]{s}*([0-9])", "n° $1", ""),
    ("n\\*{s}*([0-9])", "n° $1", ""),
    ("n%{s}*([0-9])", "n° $1", ""),
    ("ntt([0-9])", "n° $1", ""),
    ("n\\^([0-9])", "n° $1", ""),
    ("8[®™]™?{s}*étage", "8ème étage", ""),
    ("8\\*1\\*{s}*étage", "8ème étage", ""),
    ("{B}([0-9]+){s}+E,", "$1 €,", ""),
    ("{B}([0-9]+){s}+£", "$1 €", ""),
    ("{B}te{s}+(Juge|jugement|jugé){B}", "le $1", "i"),
    ("{B}tes{s}+(demandes|délais|dépens|locaux|lieux|parties){B}", "les $1", "i"),
    ("{B}ta{s}+(société|somme|saisie|décision|charge){B}", "la $1", "i"),
    ("{B}artide{B}", "article", ""),
    ("{B}auAence{B}", "audience", ""),
    ("{B}irrépetibies{B}", "irrépétibles", ""),
    ("{B}irrépétibies{B}", "irrépétibles", ""),
    ("{B}jvge{B}", "juge", ""),
    ("{B}préjudee{B}", "préjudice", ""),
    ("{B}appEcation{B}", "application", ""),
    ("RECONVERSION{s}+N{s}+ELLE", "RECONVENTIONNELLE", ""),
    ("RECONVENTTONNELS", "RECONVENTIONNELS", ""),
    ("DEMANDEURS{s}+RECONVENTTONNELS", "DEMANDEURS RECONVENTIONNELS", ""),
    ("^Art[»]+\\*+{s}*:{s}*", "", "m1"),
    ("■", "", ""),
    ("\ufffd", "?", ""),
    ("[ \\t]{2,}", " ", ""),
    ("^{s}+$", "", "m"),
]

#: Fixed values. Noise: (label, weight, pattern).
NOISE_RULES = [
    ("date_ordinale", 2, "{B}(?:ler|1°[\"'\\\\])"),
    ("apostrophe_collee", 2, "[a-zA-ZÀ-ÿ]\"[a-zA-ZÀ-ÿ]"),
    ("char_invalide", 3, "[\ufffd£©®]"),
    ("mot_casse", 2, "de-référ"),
    ("casse_incoherente", 1, "{B}[A-Z]{2,}[a-z]{1,2}{B}"),
    ("degre_parasite", 2, "°[\"'`\\\\]"),
    ("espaces_multiples", 1, "{line_ws}{3,}"),
    ("char_parasite", 3, "gem£"),
    ("mots_tres_courts", 1, "{B}[A-Za-z0-9_]{1,2}{s}+[A-Za-z0-9_]{1,2}{s}+[A-Za-z0-9_]{1,2}{s}+[A-Za-z0-9_]{1,2}{B}"),
]

#: Fixed values. Suspicious patterns, for inspection.
SUSPICIOUS = [
    ("weirdDates", "{B}(?:ler|1°[^C0-9{ws}])"),
    ("brokenWords", "[a-zA-ZÀ-ÿ]-\\n[a-zA-ZÀ-ÿ]"),
    ("gluedApostrophes", "[a-zA-ZÀ-ÿ]\"[a-zA-ZÀ-ÿ]"),
    ("parasiteChars", "[£©®\ufffd°][\"'`\\\\][a-zA-ZÀ-ÿ]"),
    ("allCapsBlocks", "{B}[A-Z]{5,}{B}"),
]

#: Fixed values. Line scores.
NUMERIC_LINE = "^[0-9{ws}.,;:\\-*•]+\\z"
EXOTIC = "[^a-zA-ZÀ-ÿœæÆŒ0-9{ws}.,;:!?()\\[\\]'\"«»\\-/€°•\u2019\u2014\u2013]"
HARD_RUN = "[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{6,}"
LONG_WORD = "{B}[a-zA-ZÀ-ÿ]{4,}{B}"
VOWEL = "[aeiouyAEIOUYàâäéèêëîïôùûüÀÂÉÈÊËÎÏÔÙÛÜ]"
FILL = "[A-Za-z0-9_]{2,}_{4,}|_{6,}"
CRAZY_CASE = "{B}[a-z]{2,}[A-Z]{2,}[a-z]{2,}{B}|{B}[A-Z]{2,}[a-z]{2,}[A-Z]{2,}{B}"
EMOJI = {"clean": "🟢", "moyen": "🟡", "gibberish": "🔴", "bruite": "🔴"}
