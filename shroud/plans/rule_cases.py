"""One line of text for each rule of a language, and the findings that it has to give, written out."""

from __future__ import annotations

TEXTS = (
    ("de", "das sagte Dr. med. Quellmann heute"),
    ("de", "wir sahen Anna Becker dort"),
    ("de", "Becker, Anna\nweiter"),
    ("de", "mit freundlichen Grüßen\nJanos Quirl"),
    ("de", "die Nordlicht & Partner GmbH & Co. KG liefert"),
    ("de", "Hallo Quentin, wie geht es"),
    ("de", "Frau Quast rief an, dann kam Ulla Quast."),
    ("de", "Anruf Telefon 0171 9876543 bitte"),
    ("de", "Name        Personalnummer  Konto\nKlein, Eva  5512            5512"),
    ("en", "the director is Ada Quist today"),
    ("en", "we met Ada Jackson, Director of sales"),
    ("en", "Yours sincerely\nAda Quist"),
    ("en", "at Harbour Road 5, Leeds LS1 4AP"),
    ("en", "Employee no.: NGE-204"),
    ("sv", "Foto: Karin Quist"),
    ("sv", "Hälsningar\nNils Quist"),
    ("sv", "vi på Quist & Co AB säljer"),
    ("ar", "السيدة ليلى الحربي"),
    ("ar", "هاتف ٠١٢٣٤٥٦٧٨ شكراً"),
    ("ar", "سافر أحمد أمس"),
    ("fr", "hier Jeanne Dupont est venue"),
    ("fr", "Madame Quart arrive"),
    ("es", "ayer Juan Quito vino"),
)
#: Number of the text, rule, kind, state, value.
FINDINGS = (
    (0, "de:title", "Person", "Protected", "Quellmann"),
    (1, "de:name-dictionary", "Person", "Suggested", "Anna"),
    (1, "de:name-dictionary", "Person", "Suggested", "Becker"),
    (2, "de:name-reversed-pair", "Person", "Suggested", "Becker"),
    (2, "de:name-reversed-pair", "Person", "Suggested", "Anna"),
    (3, "de:signature", "Person", "Protected", "Janos"),
    (3, "de:signature", "Person", "Protected", "Quirl"),
    (4, "de:company-form", "Company", "Suggested", "Nordlicht & Partner GmbH & Co. KG"),
    (5, "de:greeting", "Person", "Suggested", "Quentin"),
    (6, "de:salutation", "Person", "Protected", "Quast"),
    (6, "de:given-name", "Person", "Suggested", "Ulla"),
    (7, "de:local-phone", "Phone", "Protected", "0171 9876543"),
    (8, "de-29", "Person", "Protected", "Klein"),
    (8, "de-29", "Person", "Protected", "Eva"),
    (8, "de-31", "EmployeeNo", "Protected", "5512"),
    (8, "de-13", "Account", "Protected", "5512"),
    (9, "en:role-beside-a-name", "Person", "Suggested", "Ada"),
    (9, "en:role-beside-a-name", "Person", "Suggested", "Quist"),
    (10, "en:role-beside-a-name", "Person", "Suggested", "Ada"),
    (10, "en:role-beside-a-name", "Person", "Suggested", "Jackson"),
    (11, "en:signature", "Person", "Protected", "Ada"),
    (11, "en:signature", "Person", "Protected", "Quist"),
    (12, "en:address", "Address", "Suggested", "5, Leeds LS1 4AP"),
    (13, "en-48", "EmployeeNo", "Protected", "NGE-204"),
    (14, "sv-12", "Person", "Protected", "Karin"),
    (14, "sv-12", "Person", "Protected", "Quist"),
    (15, "sv:signature", "Person", "Protected", "Nils"),
    (15, "sv:signature", "Person", "Protected", "Quist"),
    (16, "sv:company-form", "Company", "Suggested", "Quist & Co AB"),
    (17, "ar:salutation", "Person", "Protected", "ليلى"),
    (17, "ar:salutation", "Person", "Protected", "الحربي"),
    (18, "ar:digits-local", "Phone", "Suggested", "٠١٢٣٤٥٦٧٨"),
    (19, "ar:name-library", "Person", "Suggested", "أحمد"),
    (20, "fr:name-shape", "Person", "Suggested", "Jeanne"),
    (20, "fr:name-shape", "Person", "Suggested", "Dupont"),
    (21, "fr:title", "Person", "Suggested", "Quart"),
    (22, "es:name-shape", "Person", "Suggested", "Juan"),
    (22, "es:name-shape", "Person", "Suggested", "Quito"),
)
