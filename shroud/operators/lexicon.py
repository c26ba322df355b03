"""Words and label rows of each language. They have to equal the published rule sets for equal results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LabelRow:
    id: str
    set: str
    label: str
    kind: str
    validator: str
    decision: str
    source: str = "LanguagePack"


# World label rows (id, set, label, kind, validator, decision).
WORLD_LABELS = (
    LabelRow("zz-01", "zz", "bic", "Bic", "Grouped", "auto"),
    LabelRow("zz-02", "zz", "swift", "Bic", "Grouped", "auto"),
    LabelRow("zz-03", "zz", "iban", "Iban", "Grouped", "auto"),
)
# German label rows (id, set, label, kind, validator, decision).
GERMAN_LABELS = (
    LabelRow("de-01", "de", "telefon", "Phone", "Number", "auto"),
    LabelRow("de-02", "de", "tel", "Phone", "Number", "auto"),
    LabelRow("de-03", "de", "tel.", "Phone", "Number", "auto"),
    LabelRow("de-04", "de", "mobil", "Phone", "Number", "auto"),
    LabelRow("de-05", "de", "handy", "Phone", "Number", "auto"),
    LabelRow("de-06", "de", "fax", "Phone", "Number", "auto"),
    LabelRow("de-07", "de", "e-mail", "Email", "Mail", "auto"),
    LabelRow("de-08", "de", "email", "Email", "Mail", "auto"),
    LabelRow("de-09", "de", "mail", "Email", "Mail", "auto"),
    LabelRow("de-10", "de", "iban", "Iban", "Grouped", "auto"),
    LabelRow("de-11", "de", "bic", "Bic", "Grouped", "auto"),
    LabelRow("de-12", "de", "kontonummer", "Account", "Number", "auto"),
    LabelRow("de-13", "de", "konto", "Account", "Number", "auto"),
    LabelRow("de-40", "de", "postfach", "Address", "Number", "auto"),
    LabelRow("de-41", "de", "bankverbindung", "Company", "Name", "suggest"),
    LabelRow("de-42", "de", "bank", "Company", "Name", "suggest"),
    LabelRow("de-43", "de", "kreditinstitut", "Company", "Name", "suggest"),
    LabelRow("de-14", "de", "kundennummer", "CustomerNo", "Number", "auto"),
    LabelRow("de-15", "de", "kunden-nr.", "CustomerNo", "Number", "auto"),
    LabelRow("de-16", "de", "kundennr.", "CustomerNo", "Number", "auto"),
    LabelRow("de-17", "de", "steuernummer", "TaxId", "Word", "auto"),
    LabelRow("de-18", "de", "steuer-nr.", "TaxId", "Word", "auto"),
    LabelRow("de-19", "de", "ust-idnr.", "TaxId", "Word", "auto"),
    LabelRow("de-20", "de", "ust-id", "TaxId", "Word", "auto"),
    LabelRow("de-21", "de", "umsatzsteuer-id", "TaxId", "Word", "auto"),
    LabelRow("de-22", "de", "ansprechpartner", "Person", "Name", "suggest"),
    LabelRow("de-23", "de", "personalausweisnummer", "IdCard", "Word", "auto"),
    LabelRow("de-24", "de", "personalausweis", "IdCard", "Word", "auto"),
    LabelRow("de-25", "de", "ausweisnummer", "IdCard", "Word", "auto"),
    LabelRow("de-26", "de", "kennzeichen", "Vehicle", "Any", "auto"),
    LabelRow("de-27", "de", "geboren am", "Birthdate", "Word", "auto"),
    LabelRow("de-28", "de", "geburtsdatum", "Birthdate", "Word", "auto"),
    LabelRow("de-29", "de", "name", "Person", "Name", "auto"),
    LabelRow("de-30", "de", "durchwahl", "Phone", "Number", "auto"),
    LabelRow("de-31", "de", "personalnummer", "EmployeeNo", "Number", "auto"),
    LabelRow("de-32", "de", "personal-nr.", "EmployeeNo", "Number", "auto"),
    LabelRow("de-33", "de", "personalnr.", "EmployeeNo", "Number", "auto"),
    LabelRow("de-34", "de", "pers.-nr.", "EmployeeNo", "Number", "auto"),
    LabelRow("de-35", "de", "sozialversicherungsnummer", "SocialInsuranceNo", "Word", "auto"),
    LabelRow("de-36", "de", "sv-nummer", "SocialInsuranceNo", "Word", "auto"),
    LabelRow("de-37", "de", "rentenversicherungsnummer", "SocialInsuranceNo", "Word", "auto"),
    LabelRow("de-38", "de", "steuer-id", "TaxId", "Word", "auto"),
    LabelRow("de-39", "de", "steuerliche identifikationsnummer", "TaxId", "Word", "auto"),
    LabelRow("de-31", "de", "rechnung", "Contract", "Any", "suggest"),
    LabelRow("de-32", "de", "rechnungsnummer", "Contract", "Any", "suggest"),
)
# English label rows (id, set, label, kind, validator, decision).
ENGLISH_LABELS = (
    LabelRow("en-01", "en", "telephone", "Phone", "Number", "auto"),
    LabelRow("en-02", "en", "phone", "Phone", "Number", "auto"),
    LabelRow("en-03", "en", "tel", "Phone", "Number", "auto"),
    LabelRow("en-04", "en", "mobile", "Phone", "Number", "auto"),
    LabelRow("en-05", "en", "cell", "Phone", "Number", "auto"),
    LabelRow("en-06", "en", "fax", "Phone", "Number", "auto"),
    LabelRow("en-07", "en", "e-mail", "Email", "Mail", "auto"),
    LabelRow("en-08", "en", "email", "Email", "Mail", "auto"),
    LabelRow("en-09", "en", "iban", "Iban", "Grouped", "auto"),
    LabelRow("en-10", "en", "bic", "Bic", "Grouped", "auto"),
    LabelRow("en-11", "en", "swift", "Bic", "Grouped", "auto"),
    LabelRow("en-12", "en", "account number", "Account", "Number", "auto"),
    LabelRow("en-13", "en", "account no.", "Account", "Number", "auto"),
    LabelRow("en-14", "en", "customer number", "CustomerNo", "Number", "auto"),
    LabelRow("en-15", "en", "customer no.", "CustomerNo", "Number", "auto"),
    LabelRow("en-16", "en", "client number", "CustomerNo", "Number", "auto"),
    LabelRow("en-17", "en", "account", "Account", "Number", "auto"),
    LabelRow("en-18", "en", "vat number", "TaxId", "Word", "auto"),
    LabelRow("en-19", "en", "vat id", "TaxId", "Word", "auto"),
    LabelRow("en-20", "en", "tax id", "TaxId", "Word", "auto"),
    LabelRow("en-21", "en", "tax number", "TaxId", "Word", "auto"),
    LabelRow("en-22", "en", "contact person", "Person", "Name", "auto"),
    LabelRow("en-23", "en", "contact", "Person", "Name", "auto"),
    LabelRow("en-24", "en", "attention", "Person", "Name", "auto"),
    LabelRow("en-25", "en", "managing director", "Person", "Name", "auto"),
    LabelRow("en-26", "en", "prepared by", "Person", "Name", "auto"),
    LabelRow("en-27", "en", "approved by", "Person", "Name", "auto"),
    LabelRow("en-28", "en", "authorised by", "Person", "Name", "auto"),
    LabelRow("en-29", "en", "authorized by", "Person", "Name", "auto"),
    LabelRow("en-30", "en", "case handler", "Person", "Name", "auto"),
    LabelRow("en-31", "en", "national id", "TaxId", "Number", "auto"),
    LabelRow("en-32", "en", "national id number", "TaxId", "Number", "auto"),
    LabelRow("en-33", "en", "national identity number", "TaxId", "Number", "auto"),
    LabelRow("en-34", "en", "national insurance number", "SocialInsuranceNo", "NationalInsurance", "auto"),
    LabelRow("en-42", "en", "national insurance", "SocialInsuranceNo", "NationalInsurance", "auto"),
    LabelRow("en-43", "en", "ni number", "SocialInsuranceNo", "NationalInsurance", "auto"),
    LabelRow("en-35", "en", "personal id", "TaxId", "Number", "auto"),
    LabelRow("en-36", "en", "personal identity number", "TaxId", "Number", "auto"),
    LabelRow("en-37", "en", "social security number", "TaxId", "Number", "auto"),
    LabelRow("en-38", "en", "ssn", "TaxId", "Number", "auto"),
    LabelRow("en-44", "en", "date of birth", "Birthdate", "Date", "auto"),
    LabelRow("en-45", "en", "dob", "Birthdate", "Date", "auto"),
    LabelRow("en-46", "en", "born", "Birthdate", "Date", "auto"),
    LabelRow("en-47", "en", "employee number", "EmployeeNo", "Reference", "auto"),
    LabelRow("en-48", "en", "employee no.", "EmployeeNo", "Reference", "auto"),
    LabelRow("en-49", "en", "employee no", "EmployeeNo", "Reference", "auto"),
    LabelRow("en-50", "en", "staff id", "EmployeeNo", "Reference", "auto"),
    LabelRow("en-39", "en", "registration number", "Contract", "Number", "auto"),
    LabelRow("en-40", "en", "company number", "Contract", "Number", "auto"),
    LabelRow("en-41", "en", "company registration number", "Contract", "Number", "auto"),
)
# Swedish label rows (id, set, label, kind, validator, decision).
SWEDISH_LABELS = (
    LabelRow("sv-01", "sv", "telefon", "Phone", "Number", "auto"),
    LabelRow("sv-02", "sv", "mobil", "Phone", "Number", "auto"),
    LabelRow("sv-03", "sv", "e-post", "Email", "Mail", "auto"),
    LabelRow("sv-04", "sv", "epost", "Email", "Mail", "auto"),
    LabelRow("sv-05", "sv", "personnummer", "TaxId", "Number", "auto"),
    LabelRow("sv-06", "sv", "organisationsnummer", "TaxId", "Number", "auto"),
    LabelRow("sv-07", "sv", "org.nr", "TaxId", "Number", "auto"),
    LabelRow("sv-08", "sv", "kundnummer", "CustomerNo", "Number", "auto"),
    LabelRow("sv-09", "sv", "fakturanummer", "Contract", "Number", "auto"),
    LabelRow("sv-10", "sv", "adress", "Address", "Any", "suggest"),
    LabelRow("sv-11", "sv", "kontaktperson", "Person", "Name", "suggest"),
    LabelRow("sv-12", "sv", "foto", "Person", "NamePair", "auto"),
    LabelRow("sv-13", "sv", "fotograf", "Person", "NamePair", "auto"),
    LabelRow("sv-14", "sv", "bild", "Person", "NamePair", "auto"),
    LabelRow("sv-15", "sv", "verkställande direktör", "Person", "Name", "auto"),
    LabelRow("sv-16", "sv", "vd", "Person", "Name", "auto"),
    LabelRow("sv-17", "sv", "sammanställd av", "Person", "Name", "auto"),
    LabelRow("sv-18", "sv", "attesterad av", "Person", "Name", "auto"),
    LabelRow("sv-19", "sv", "godkänd av", "Person", "Name", "auto"),
    LabelRow("sv-20", "sv", "handläggare", "Person", "Name", "auto"),
)
LABELS = {"zz": list(WORLD_LABELS), "de": list(GERMAN_LABELS), "en": list(ENGLISH_LABELS), "sv": list(SWEDISH_LABELS)}


@dataclass(frozen=True)
class Pack:
    """A language's words; a list that a language doesn't have is empty."""

    id: str
    locale: str
    honorifics: frozenset = frozenset()
    salutations: frozenset = frozenset()
    greetings: frozenset = frozenset()
    titles: frozenset = frozenset()
    title_parts: frozenset = frozenset()
    degrees: frozenset = frozenset()
    function_words: frozenset = frozenset()
    stop_words: frozenset = frozenset()
    closings: frozenset = frozenset()
    roles: frozenset = frozenset()
    copulas: frozenset = frozenset()
    company_forms: frozenset = frozenset()
    conjunctions: frozenset = frozenset()
    family_suffixes: tuple = ()
    names_by_shape: bool = False
    more: dict = field(default_factory=dict)


def _words(*words: str) -> frozenset:
    return frozenset(words)


# The words of each language.
DE = Pack(
    "de", "de-DE",
    honorifics=_words("herr", "herrn", "frau", "fr.", "hr.", "dr.", "dr", "prof.", "prof", "dipl.-ing.", "ing."),
    salutations=_words("Herr", "Herrn", "Frau", "Fr.", "Hr."),
    greetings=_words("Hallo"),
    titles=_words("Dr.", "Dr", "Dr.in", "DDr.", "MMag.", "Mag.", "Mag", "Mag.a", "Prof.", "Prof", "Univ.-Prof.", "Univ.-Doz.", "Priv.-Doz.", "PD", "Prim.", "Prim", "DI", "Dipl.-Ing.", "Dipl.-Kfm.", "Ing.", "Bakk."),
    title_parts=_words("med.", "rer.", "nat.", "phil.", "techn.", "univ.", "h.c.", "mult."),
    degrees=_words("MBA", "MSc", "BSc", "BA", "MA", "LL.M.", "PhD", "MPH", "MAS", "CFA"),
    function_words=_words("an", "nur", "per", "mal", "anders"),
    stop_words=_words("Die", "Der", "Das", "Den", "Dem", "Des", "Ein", "Eine", "Einer", "Eines", "Unser", "Unsere", "Ihr", "Ihre", "Seine", "Mit", "Von", "An", "Bei", "Für", "Und", "Als", "Auch", "Diese", "Dieser", "Dieses", "Im", "In", "Am", "Zur", "Zum", "Wir", "Sie", "Es", "Herzlich"),
    closings=_words("grüßen", "grüssen", "grüße", "grüsse", "hochachtungsvoll"),
    roles=_words("geschäftsführer", "geschäftsführerin", "inhaber", "inhaberin", "i.a.", "ppa.", "prokurist", "vorstand", "mitglied"),
    company_forms=_words("GmbH", "AG", "UG", "KG", "OHG", "GbR", "SE", "e.K.", "eG", "mbH", "KGaA"),
    conjunctions=_words("&", "und"),
    more={
        "streets": ("straße", "strasse", "str.", "str", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer"),
        "phone_words": _words("telefon", "telefonnummer", "tel", "tel.", "mobil", "handy", "durchwahl", "fax", "rufnummer"),
    },
)
EN = Pack(
    "en", "en-GB",
    honorifics=_words("mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "dr", "dr.", "prof", "prof."),
    salutations=_words("Mr", "Mrs", "Ms", "Miss", "Mx", "Mr.", "Mrs.", "Ms.", "Dame"),
    greetings=_words("Hi", "Hello"),
    titles=_words("Dr", "Dr.", "Prof", "Prof.", "Rev", "Rev.", "Hon", "Hon.", "Sir", "Lord", "Lady"),
    degrees=_words("MBA", "MSc", "BSc", "BA", "MA", "PhD", "LLB", "LLM", "FCA", "ACA", "ACCA", "FCCA", "CIMA", "MBE", "OBE", "CBE"),
    function_words=_words("and", "or", "but", "the", "a", "an", "of", "for", "with", "from", "to", "as", "that", "this", "our", "your", "his", "her", "their", "is", "are", "was", "were", "please", "thank"),
    stop_words=_words("The", "This", "That", "These", "Those", "We", "Our", "I", "My", "You", "Your", "Dear", "If", "As", "And", "But", "First", "Second", "Third", "Payment", "Invoice", "Account", "Client", "Contact", "Email", "Telephone", "Mobile", "Date", "Person", "Reason", "Season", "Lesson", "Comparison", "Poison", "Prison", "Treason", "Garrison", "Unison", "Arson", "Venison", "Crimson"),
    closings=_words("sincerely", "faithfully", "regards", "truly", "yours"),
    roles=_words("director", "partner", "manager", "officer", "accountant", "bookkeeper", "supervisor", "controller", "treasurer", "secretary", "chairman", "chair", "owner", "consultant", "administrator", "solicitor", "auditor"),
    copulas=_words("is"),
    company_forms=_words("Ltd", "Ltd.", "Limited", "LLP", "LLC", "Inc", "Inc.", "Incorporated", "plc", "PLC", "Plc", "Corp", "Corp.", "Corporation"),
    conjunctions=_words("&", "and"),
    family_suffixes=("son",),
)
SV = Pack(
    "sv", "sv-SE",
    honorifics=_words("herr", "fru", "fröken", "dr", "dr.", "prof", "prof."),
    salutations=_words("Herr", "Fru", "Fröken", "Hr", "Fr"),
    greetings=_words("Hej"),
    titles=_words("Dr.", "Dr", "Prof.", "Prof", "Docent", "Civ.ing.", "Ing.", "Adv.", "Leg."),
    degrees=_words("MBA", "MSc", "BSc", "PhD", "civ.ek."),
    function_words=_words("och", "som", "men", "bara", "att", "för"),
    stop_words=_words("Den", "Det", "De", "Denna", "Detta", "Dessa", "En", "Ett", "Vi", "Vår", "Våra", "Jag", "Hej", "Med", "Till", "Från", "Enligt", "Samt", "Och", "Men", "Som"),
    closings=_words("hälsningar", "vänligen", "hälsning", "mvh"),
    roles=_words("vd", "ägare", "chef", "ordförande", "styrelseledamot", "konsult", "projektledare", "professor", "forskningssekreterare", "programchef", "direktör", "löneassistent"),
    copulas=_words("är"),
    company_forms=_words("AB", "HB", "KB", "AB.", "Ekonomisk", "Handelsbolag", "Kommanditbolag"),
    conjunctions=_words("&", "och"),
    family_suffixes=("son", "dotter", "ström", "qvist", "berg", "lund", "gren", "stedt"),
)
AR = Pack(
    "ar", "ar-SA",
    salutations=_words("السيد", "السيدة", "السادة", "سيدي", "سيدتي"),
    titles=_words("الدكتور", "الدكتورة", "دكتور", "دكتورة", "د.", "الأستاذ", "الأستاذة", "أستاذ", "أستاذة", "أ.", "المهندس", "المهندسة", "مهندس", "مهندسة", "الشيخ", "الشيخة", "المحامي", "المحامية", "الأستاذ الدكتور"),
    function_words=_words("في", "من", "إلى", "على", "عن", "مع", "و", "أو", "ثم", "قد", "كان", "كانت", "بتاريخ", "التالي", "التالية", "الذي", "التي", "هو", "هي", "هذا", "هذه", "لدى", "لديكم", "بن؟", "رقم", "اسم", "الساعة", "يوم", "بعد", "قبل", "حتى", "إنّ", "أن", "أنّ", "لا", "ما", "كل", "بعض", "غير", "بين", "حول", "عند"),
    stop_words=_words("الموضوع", "شكراً", "وتفضلوا", "وقد", "وكما", "للاستفسار"),
    company_forms=_words("ذ.م.م", "ش.م.م", "ش.م.ك", "ش.م.س", "المحدودة", "وشركاه"),
    conjunctions=_words("و", "&", "وشركاه"),
    more={
        "courtesies": _words("الفاضلة", "الفاضل", "المحترم", "المحترمة", "الكريم", "الكريمة", "الموقر", "الموقرة", "حفظه", "حفظها"),
        "fixed": frozenset({("فائق", "الاحترام"), ("فائق", "التقدير"), ("فائق", "الشكر"), ("خالص", "الشكر"), ("خالص", "التقدير"), ("خالص", "الاحترام"), ("خالص", "التحيات"), ("وافر", "الاحترام"), ("وافر", "التقدير"), ("جميل", "الشكر")}),
    },
)
FR = Pack(
    "fr", "fr-FR",
    titles=_words("Monsieur", "Madame", "Mademoiselle", "M.", "Mme", "Mme.", "Mlle", "Mlle.", "Maître", "Me", "Docteur", "Dr", "Dr."),
    function_words=_words("le", "la", "les", "de", "du", "des", "et", "ou", "à", "au", "aux", "en", "pour", "par", "avec", "sur"),
    stop_words=_words("Le", "La", "Les", "Ce", "Cet", "Cette", "Ces", "Un", "Une", "Des", "Du", "De", "Il", "Elle", "Ils", "Elles", "Nous", "Vous", "Je", "On", "Mon", "Ma", "Mes", "Ton", "Ta", "Tes", "Son", "Sa", "Ses", "Notre", "Nos", "Votre", "Vos", "Leur", "Leurs", "Au", "Aux", "À", "Dans", "Pour", "Par", "Avec", "Sans", "Sur", "Sous", "Selon", "Chez", "Entre", "Depuis", "Après", "Avant", "Pendant", "Et", "Mais", "Ou", "Donc", "Or", "Ni", "Car", "Si", "Comme", "Quand", "Qui", "Que", "Quoi", "Tout", "Tous", "Toute", "Toutes", "Bonjour", "Bonsoir", "Merci", "Cher", "Chère", "Chers", "Chères", "Objet", "Veuillez", "Cordialement", "Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche", "Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"),
    company_forms=_words("SA", "SAS", "SASU", "SARL", "EURL", "SCI", "SNC"),
    names_by_shape=True,
)
ES = Pack(
    "es", "es-ES",
    titles=_words("Señor", "Señora", "Señorita", "Sr.", "Sr", "Sra.", "Sra", "Srta.", "Srta", "Don", "Doña", "D.", "Dña.", "Doctor", "Doctora", "Dr.", "Dra."),
    function_words=_words("el", "la", "los", "las", "de", "del", "y", "e", "o", "u", "a", "al", "en", "con", "por", "para"),
    stop_words=_words("El", "La", "Los", "Las", "Lo", "Este", "Esta", "Esto", "Estos", "Estas", "Ese", "Esa", "Eso", "Esos", "Esas", "Aquel", "Aquella", "Un", "Una", "Unos", "Unas", "Yo", "Tú", "Él", "Ella", "Nosotros", "Nosotras", "Vosotros", "Vosotras", "Ellos", "Ellas", "Usted", "Ustedes", "Mi", "Mis", "Tu", "Tus", "Su", "Sus", "Nuestro", "Nuestra", "Nuestros", "Nuestras", "Al", "Del", "De", "En", "Con", "Por", "Para", "Sin", "Sobre", "Según", "Desde", "Hasta", "Entre", "Tras", "Y", "E", "Pero", "O", "U", "Si", "Como", "Cuando", "Que", "Quien", "Todo", "Toda", "Todos", "Todas", "Hola", "Gracias", "Estimado", "Estimada", "Estimados", "Querido", "Querida", "Atentamente", "Asunto", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo", "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Setiembre", "Octubre", "Noviembre", "Diciembre"),
    company_forms=_words("S.A.", "S.L.", "S.L.U.", "S.A.U.", "SA", "SL", "SLU", "SAU"),
    names_by_shape=True,
)
PACKS = {p.id: p for p in (DE, EN, SV, AR, FR, ES)}

#: A short list of our own; a real name bank comes as a table (see names.py).
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "de": (("anna", "ben", "clara", "david", "emma", "felix", "greta", "hanna", "jonas", "karl", "lena", "lukas", "maria", "markus", "nina", "paul", "sofia", "thomas", "katrin", "sven",), ("bauer", "becker", "fischer", "hoffmann", "keller", "koch", "krause", "lehmann", "meyer", "müller", "richter", "schmidt", "schneider", "schulz", "wagner", "weber", "wolf",)),
    "en": (("alice", "benjamin", "charles", "daniel", "edward", "emily", "george", "grace", "harry", "jack", "james", "john", "laura", "mary", "oliver", "peter", "sarah", "thomas", "william",), ("baker", "brown", "clark", "cooper", "davies", "evans", "green", "hall", "harris", "hughes", "jones", "moore", "roberts", "smith", "taylor", "turner", "walker", "white", "wilson",)),
    "sv": (("anders", "anna", "björn", "elin", "emma", "erik", "eva", "gustav", "ingrid", "johan", "karin", "lars", "maja", "nils", "sara", "sven",), ("andersson", "eriksson", "gustafsson", "johansson", "karlsson", "larsson", "lindberg", "nilsson", "olsson", "persson", "svensson",)),
    "ar": (("أحمد", "محمد", "علي", "حسن", "حسين", "عمر", "خالد", "سعيد", "فاطمة", "عائشة", "مريم", "زينب", "ليلى", "سلمى", "نورة",), ()),
}


def dictionary(pack: str) -> tuple[frozenset, frozenset]:
    """Given and family names of a language, in small letters."""
    given, family = NAMES.get(pack, ((), ()))
    return frozenset(given), frozenset(family)
