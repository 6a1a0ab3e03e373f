"""Known licence sentences, names of licences, and the ordered rules over identifiers (fixed values).

A sentence is written as it looks after normalisation: lower case, every run of other characters than letters and digits
turned into one blank. ``#`` stands for a version ("2", "v2 1", "version 2 0"); in an identifier it stands for the version
found, with a point.
"""

from __future__ import annotations

SENTENCES: list[tuple[str, str]] = [
    ("copyright", "copyright c"),
    ("copyright", "copyright #"),
    ("all-rights", "all rights reserved"),
    ("later-#", "# of the license or at your option any later version"),
    ("later-#", "# of the license or any later version"),
    ("later", "or at your option any later version"),
    ("only-#", "# of the license"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("as-is", "the software is provided as is"),
    ("as-is", "provided by the copyright holders and contributors as is"),
    ("as-is", "provided as is without any express or implied warranty"),
    ("no-liability", "in no event shall the authors or copyright holders be liable"),
    ("no-liability", "in no event shall the copyright holder or contributors be liable"),
    ("no-liability", "in no event shall the copyright owner or contributors be liable"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "may be used to endorse or promote products derived from this software"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense-grant", "this is free and unencumbered software released into the public domain"),
    ("wtfpl-grant", "you just do what the fuck you want to"),
]

# Words that come before the name of the licence that a work is under.
LEADS = [
    "licensed under", "released under", "distributed under", "available under", "published under", "provided under", "offered under",
    "licensed to you under", "under the terms of", "under terms of", "under the terms and conditions of", "subject to the terms of",
    "governed by", "spdx license identifier",
]

# Names by family, as texts and as tags write them.
NAMES: dict[str, list[str]] = {
    "gpl": ["gnu general public license", "general public license", "gnu gpl", "gpl"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl", "lgpl"],
    "agpl": ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"],
    "apache": ["apache license", "apache software license", "apache"],
    "mpl": ["mozilla public license", "mpl"],
    "epl": ["eclipse public license", "epl"],
    "cddl": ["common development and distribution license", "cddl"],
    "eupl": ["european union public license", "eupl"],
    "ofl": ["sil open font license", "ofl"],
    "artistic": ["artistic license"],
    "boost": ["boost software license", "bsl"],
    "cc0": ["cc0", "creative commons zero"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
}
# Names without a version.
PLAIN_NAMES: dict[str, list[str]] = {
    "mit": ["mit license", "mit", "expat license"],
    "bsd-3": ["bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "3 clause bsd", "new bsd license", "modified bsd license"],
    "bsd-2": ["bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "2 clause bsd", "simplified bsd license"],
    "bsd-0": ["0bsd", "zero clause bsd license", "bsd zero clause license"],
    "bsd": ["bsd license", "bsd style license", "bsd"],
    "isc": ["isc license", "isc"],
    "zlib": ["zlib license", "zlib"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl"],
    "postgresql": ["postgresql license"],
}

_GNU = [("GPL", "gpl", ["1.0", "2.0", "3.0"]), ("LGPL", "lgpl", ["2.0", "2.1", "3.0"]), ("AGPL", "agpl", ["1.0", "3.0"])]
_VERSIONED = [
    ("Apache", "apache", ["1.0", "1.1", "2.0"]), ("MPL", "mpl", ["1.0", "1.1", "2.0"]), ("EPL", "epl", ["1.0", "2.0"]), ("CDDL", "cddl", ["1.0", "1.1"]),
    ("EUPL", "eupl", ["1.0", "1.1", "1.2"]), ("OFL", "ofl", ["1.0", "1.1"]), ("Artistic", "artistic", ["1.0", "2.0"]), ("BSL", "boost", ["1.0"]),
    ("CC0", "cc0", ["1.0"]),
    *((name.upper(), name, ["2.0", "3.0", "4.0"]) for name in ("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd")),
]

# Ordered: the first rules are the more special ones; sentences a rule has used up are taken out before the next rule is
# tried. A rule is a sequence of identifiers that follow each other in the text.
RULES: list[tuple[str, list[str]]] = [
    *(("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", *end]) for end in (["as-is", "no-liability"], ["as-is"], [])),
    *(("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", *end]) for end in (["as-is", "no-liability"], ["as-is"], [])),
    *(("MIT", ["mit-grant", "mit-notice", *end]) for end in (["as-is", "no-liability"], ["as-is"], [])),
    *(("ISC", ["isc-grant", *end]) for end in (["as-is"], [])),
    *(("Zlib", [*start, "zlib-grant"]) for start in (["as-is"], [])),
    ("BSL-1.0", ["boost-grant"]), ("Unlicense", ["unlicense-grant"]), ("WTFPL", ["wtfpl-grant"]),
    ("Apache-2.0", ["apache-2.0", "apache-use", "apache-copy"]),
    *(
        (f"{name}-{v}-{kind}", sequence)
        for name, family, versions in _GNU for v in versions
        for kind, sequence in (
            ("or-later", [family, f"later-{v}"]), ("or-later", [f"{family}-{v}", f"later-{v}"]), ("or-later", [f"{family}-{v}", "later"]),
            ("or-later", [f"{family}-{v}-or-later"]), ("only", [family, f"only-{v}"]), ("only", [f"{family}-{v}-only"]), ("only", [f"{family}-{v}"]),
        )
    ),
    *((f"{name}-any", sequence) for name, family, _ in _GNU for sequence in ([family, "later"], [family])),
    *((f"{name}-{v}", [f"{family}-{v}"]) for name, family, versions in _VERSIONED for v in versions),
    *((name, [family]) for name, family, _ in _VERSIONED),
    ("MIT", ["mit"]), ("MIT", ["mit-grant"]),
    ("BSD-3-Clause", ["bsd-3"]), ("BSD-2-Clause", ["bsd-2"]), ("0BSD", ["bsd-0"]), ("BSD", ["bsd"]), ("BSD", ["bsd-grant"]),
    ("ISC", ["isc"]), ("Zlib", ["zlib"]), ("Unlicense", ["unlicense"]), ("WTFPL", ["wtfpl"]), ("PostgreSQL", ["postgresql"]),
    ("no-licence", ["copyright", "all-rights"]),
]
# Found only where no other licence is.
LAST = "no-licence"

# A sentence that holds one of these and is not known is a licence-like sentence.
CUES = ["licen", "copyright", "permission", "redistribut", "rights reserved", "provided as is", "endorse", "cc0"]
