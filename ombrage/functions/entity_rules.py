"""Fixed values of detection, resolution and replacement.

{L} stands for a Latin letter inside a class.
"""

L = "A-Za-zÀ-ÖØ-öø-ÿ"
UP = "A-ZÀ-Ö"

#: Fixed values. Typed patterns: (type, pattern, ignore case), in order.
PATTERNS = [
    ("REF", "{B}(?:RG|N°|N°{s}?RG)[:{ws}]+(?:[0-9][A-Z0-9/-]*){B}", True),
    ("ADRESSE", "[0-9]{1,4}(?:bis|ter)?{s}+(?:rue|avenue|boulevard|place|allée|quai|route|chemin|impasse|square|cours){s}+[^,;.\\n]+(?:{s}+[0-9]{5}{s}+[A-Z{ws}]+)?", True),
    ("SIREN", "{B}[0-9]{3}{s}?[0-9]{3}{s}?[0-9]{3}{B}", False),
    ("IBAN", "{B}FR[0-9]{2}{s}?[0-9]{4}{s}?[0-9]{4}{s}?[0-9]{4}{s}?[0-9]{4}{s}?[0-9]{3}{B}", True),
    ("EMAIL", "{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[a-z]{2,}{B}", True),
    ("PHONE", "{B}(?:0|\\+33)[1-9](?:[{ws}.-]?[0-9]{2}){4}{B}", False),
    ("NAISSANCE", "{B}n[ée]e?{s}+le{s}+[0-9]{1,2}{s}+(?:janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre){s}+(?:19|20)[0-9]{2}(?:{s}+[àa]{s}+[A-ZÀ-Öa-zà-ö][A-Za-zÀ-Öà-ö{ws}-]{2,30}(?:{s}*\\([0-9]{5}\\))?)?", True),
]
BIRTH_LABEL = "Date naissance"

#: Fixed values. Names after a title, typographic words, names beside an office.
NAME = f"[{UP}][{L}''-]{{1,}}"
TITLED = f"{{B}}(Madame|Monsieur|M\\.|Mme\\.?|Ma?ître?|Docteur|Dr\\.?|Professeur|Pr\\.?){{s}}+({NAME}(?:{{s}}+{NAME}){{0,2}}){{B}}"
TYPOGRAPHIC = "{B}(?:[A-ZÀ-Ö]{2,}|[A-ZÀ-Ö][a-zà-ö]{2,}){B}"
SENTENCE_ENDS = ".!?:«"
OFFICE_NAME = f"[{UP}][{L}''-]+"
OFFICERS = [
    (f"{{B}}({OFFICE_NAME}(?:{{s}}+{OFFICE_NAME}){{0,2}}){{s}}+(?:Avocat|Notaire|Huissier|Commissaire{{s}}+de{{s}}+[Jj]ustice){{B}}", False),
    (f"{{B}}Par{{s}}+(?:Ma?ître?|Me\\.?){{s}}+({OFFICE_NAME}(?:{{s}}+{OFFICE_NAME}){{0,2}}){{B}}", True),
]
MIXED = f"[{UP}][a-zà-öø-ÿ''-]{{1,}}"
THREE_WORDS = f"{{B}}({MIXED}{{s}}+{MIXED}{{s}}+{NAME}){{B}}"
TWO_WORDS = f"{{B}}({MIXED}{{s}}+{NAME}){{B}}"

#: Fixed values. Couples, as detection finds them.
COUPLES = [
    (f"{{B}}({MIXED}){{s}}+et{{s}}+({MIXED}){{s}}+({NAME}){{B}}", False),
    (f"{{B}}(Monsieur|M\\.){{s}}+et{{s}}+(Madame|Mme){{s}}+({NAME}){{B}}", True),
    (f"{{B}}(?:les{{s}}+époux|epoux){{s}}+({NAME}){{B}}", True),
    (f"{{B}}(?:Madame|Mme\\.?){{s}}+({NAME}(?:{{s}}+{NAME})?){{s}}+(?:épouse|epouse|veuve|née|nee){{s}}+({NAME}){{B}}", True),
]
#: Fixed values. Aliases of the three couple forms; {} is the family name.
COUPLE_ALIASES = [
    ["Monsieur et Madame {}", "Les époux {}"],
    ["M. et Mme {}", "Monsieur, Madame {}", "Les époux {}", "Les conjoints {}", "Le couple {}"],
    ["Monsieur et Madame {}", "M. et Mme {}", "Monsieur, Madame {}", "Le couple {}"],
]

#: Fixed values. Titles as detection knows them.
CIVIL_TITLES = frozenset(["monsieur", "madame", "maitre", "maître", "mme", "me", "dr", "pr", "docteur", "professeur", "m."])
COUNSEL_TITLES = frozenset(["maître", "maitre", "me", "me."])

#: Fixed values. Resolution of identities.
TITLES = frozenset(["monsieur", "madame", "m.", "mme", "mme.", "me", "me.", "maître", "maitre", "dr", "dr.", "docteur", "pr", "pr.", "professeur", "mesdames", "messieurs"])
PARTICLES = frozenset(["de", "du", "des", "d'", "le", "la", "les", "van", "von", "da", "del", "della"])
COUPLE_WORDS = frozenset(["epoux", "époux", "couple", "mari", "epouse", "épouse"])
NAME_TOKEN = f"[A-ZÀ-ÖØ-öø-ÿ][{L}''\\-]+|[A-ZÀ-Ö]{{2,}}"
WIDE_NAME = f"[A-ZÀ-ÖØ-öø-ÿ][{L}''\\-]+"
RESOLVED_COUPLES = [
    (f"{{B}}({WIDE_NAME}){{s}}+et{{s}}+({WIDE_NAME}){{s}}+({WIDE_NAME}){{B}}", False),
    (f"{{B}}(?:Monsieur|M\\.){{s}}+et{{s}}+(?:Madame|Mme){{s}}+({WIDE_NAME}){{B}}", True),
    (f"{{B}}(?:les{{s}}+époux|epoux){{s}}+({WIDE_NAME}){{B}}", True),
]
RESOLVED_COUPLE_ALIASES = [
    ["Monsieur et Madame {}", "M. et Mme {}", "Les époux {}", "Le couple {}"],
    ["M. et Mme {}", "Les époux {}", "Le couple {}", "Les conjoints {}"],
    ["Monsieur et Madame {}", "M. et Mme {}", "Le couple {}", "Les conjoints {}"],
]
SURNAME_ALIASES = ["Monsieur {}", "Madame {}", "M. {}", "Mme {}", "Mme. {}"]
FULL_NAME_ALIASES = ["Monsieur {}", "Madame {}", "M. {}", "Mme {}"]

#: Fixed values. Replacement.
PREFIXES = {"NOM": "NOM", "ENTITE": "ENTITE", "ADRESSE": "ADRESSE", "REF": "REF", "AUTRE": "AUTRE", "COUPLE": "COUPLE"}
TITLE_BEFORE = "(?:Madame|Monsieur|M\\.|Mme\\.?|Me\\.?|Maître|Maitre|Dr\\.?|Pr\\.?|Docteur|Professeur)"
TITLE_HEAD = "^(?:Madame|Monsieur|M\\.?|Mme\\.?|Mlle\\.?|Me\\.?|Maître|Maitre|Dr\\.?|Pr\\.?|Docteur|Professeur){s}+"
TITLE_WORDS = frozenset(["madame", "monsieur", "mme", "mme.", "m.", "me", "me.", "maître", "maitre", "dr", "dr.", "pr", "pr.", "docteur", "professeur"])
LEFT_BOUND = f"(?<![{L}])"
RIGHT_BOUND = f"(?![{L}])(?!_[0-9]+\\])"
REDACTIONS = {"supprime": "[SUPPRIMÉ]", "blocks": "████████", "vide": ""}
CONCORDANCE_HEADER = "Placeholder;Valeur originale;Alias;Formes remplacées;Type;Civilité forcée;Initiale"
ENTITIES_HEADER = "Valeur;Type;Alias;Actif;Bloqué"

#: Fixed values. Sides of a case and the words that name them.
SIDES = {"demandeurs": "DEMANDEUR", "defendeurs": "DEFENDEUR"}
SIDE_KEYWORDS = {
    "demandeurs": ["demandeur", "demandeurs", "requérant", "requérants", "appelant", "appelants", "plaignant", "plaignants", "demanderesse", "demanderesses"],
    "defendeurs": ["défendeur", "défendeurs", "défenderesse", "défenderesses", "intimé", "intimés", "mis en cause", "assigné", "assignés"],
}
ORDERED_ROLES = ("DEMANDEUR", "DEFENDEUR", "COUPLE_DEMANDEUR", "COUPLE_DEFENDEUR", "FAMILLE_DEMANDEUR", "FAMILLE_DEFENDEUR")
PARTY_TITLE = "(?:Madame|Monsieur|M\\.|Mme\\.?|Me\\.?|Maître|Maitre|Dr\\.?|Docteur)?{s}*"
PARTY_NAME = f"[{UP}][{L}'\\-]{{1,}}(?:{{s}}+[{UP}][{L}'\\-]{{1,}}){{0,3}}"

#: Fixed values. Omission scan: (category, type, pattern, ignore case, group).
_W = f"(?:[{UP}][a-zà-öù\\-']{{1,}}|[{UP}]{{2,}})"
_CIVIL = "(?:M\\.?|Mr\\.?|Mme\\.?|Mlle\\.?|Monsieur|Madame|Mademoiselle|Maître|Me\\.?)"
_OF = "(?:de{s}+(?:la{s}+|l['']{s}*|les{s}+|du{s}+)?)?"
OMISSIONS = [
    ("civilite", "NOM", f"{{B}}{_CIVIL}{{s}}+(?:{_W}(?:{{s}}+{_W}){{0,3}})", False, 0),
    ("adresse", "ADRESSE", f"{{B}}(?:[0-9]{{1,4}}{{s}}*(?:bis|ter|quater)?{{s}}*,?{{s}}*)(?:rue|avenue|av\\.|boulevard|bd\\.?|place|pl\\.|allée|impasse|chemin|route|voie|passage|square|rond-?point|résidence|cité|hameau|lieu-dit){{s}}+{_OF}(?:[A-ZÀ-Öa-zà-ö][A-Za-zÀ-Öà-ö{{ws}}\\-'']{{2,40}})|(?:rue|avenue|av\\.|boulevard|bd\\.?|place|pl\\.|impasse|square|rond-?point|hameau|lieu-dit){{s}}+{_OF}(?:[A-ZÀ-Ö][A-Za-zÀ-Öà-ö{{ws}}\\-'']{{2,40}})", True, 0),
    ("codepostal", "ADRESSE", "{B}[0-9]{5}{s}+[A-ZÀÂÉÈÊËÎÏÔÙÛÜ][A-ZÀÂÉÈÊËÎÏÔÙÛÜ{ws}\\-]{1,30}{B}", False, 0),
    ("org", "ENTITE", "{B}(?:SARL|SAS|SASU|SCI|SA|EURL|SNC|GIE|SCOP|SEP|SCP|SC){s}+(?:[A-ZÀ-Öa-zà-ö][A-Za-zÀ-Öà-ö0-9{ws}&\\-'.]{2,50}?)(?={s}*[,;.\\n(\\[]|\\Z)", False, 0),
    ("org", "ENTITE", "{B}(?:la{s}+société|l['']entreprise|la{s}+copropriété|le{s}+syndicat|l['']association|la{s}+compagnie|le{s}+cabinet){s}+(?:[«\"']?[A-ZÀ-Ö][A-Za-zÀ-Öà-ö0-9{ws}&\\-'.]{2,50}[«\"']?)", True, 0),
    ("civilite", "NOM", f"{{B}}(?:Commissaire{{s}}+de{{s}}+Justice|conciliateur{{s}}+de{{s}}+justice|Docteur|Professeur|Dr\\.?|Pr\\.?|Prof\\.?){{s}}+(?:{_W}(?:{{s}}+{_W}){{0,3}})", False, 0),
    ("civilite", "NOM", f"{{B}}{_CIVIL}{{s}}+[{UP}]\\.{{s}}+(?:{_W}(?:{{s}}+{_W}){{0,2}})", False, 0),
    ("civilite", "NOM", "{B}(?:de|du|par|pour|entre|avec|chez|sur|contre|concernant|logement{s}+de|dossier{s}+de|affaire|locataire){s}+([A-ZÀ-ÖØ-Ý]{3,}(?:[- ][A-ZÀ-ÖØ-Ý]{2,}){0,3}){B}", False, 1),
    ("civilite", "NOM", "\\[(?:NOM|SUPPRIMÉ|ADRESSE)[^\\]]*\\]{s}+([A-ZÀ-Ö][a-zà-öù]{3,}(?:{s}+[A-ZÀ-Ö][a-zà-öù]{2,}){0,2}){B}", False, 1),
]
