"""Licence scan by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z), cut into words and joined again; the rules are regexes over those words. A rule is tried
only where its keyword is a word of the text, and no rule where no keyword is. Of overlapping detections,
one that lies within another of the same or a higher priority is suppressed. Plain places of three phrases are counted
besides and stay whatever the rules say.

Every step is a narrow map over a row: no shuffle, so no key can be hot. Null text counts as empty; repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, keyword, name): each makes a rule for the name with "license", for a grant under it, and for its identifier.
NAMES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("mit", "x11", "x11"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[cs]e)? (?:version |v)?1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: licen[cs]e)? (?:version |v)?2(?: 0)?"),
    ("apache", "apache", "apache(?: software)?"),
    ("gpl-1.0", "gpl", "gpl (?:version |v)?1(?: 0)?"),
    ("gpl-2.0", "gpl", "gpl (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl", "gpl (?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("gpl-2.0", "gnu", "gnu general public license (?:version |v)?2"),
    ("gpl-3.0", "gnu", "gnu general public license (?:version |v)?3"),
    ("gpl", "gnu", "gnu general public"),
    ("lgpl-2.1", "lgpl", "lgpl (?:version |v)?2 1"),
    ("lgpl-2.1", "lgplv2", "lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgpl", "lgpl (?:version |v)?3(?: 0)?"),
    ("lgpl-3.0", "lgplv3", "lgplv3"),
    ("lgpl", "lesser", "gnu lesser general public"),
    ("lgpl", "library", "gnu library general public"),
    ("agpl-3.0", "agpl", "agpl (?:version |v)?3(?: 0)?"),
    ("agpl-3.0", "agplv3", "agplv3"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("gfdl", "documentation", "gnu free documentation"),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd|bsd 2 clause|simplified bsd"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd|bsd 3 clause|new bsd|modified bsd"),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd|bsd 4 clause|original bsd"),
    ("0bsd", "0bsd", "0bsd"),
    ("0bsd", "bsd", "zero clause bsd"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)? (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public(?: license)? (?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1.0", "eclipse", "eclipse public(?: license)? (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public(?: license)? (?:version |v)?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("eupl", "european", "european union public"),
    ("artistic-2.0", "artistic", "artistic(?: license)? (?:version |v)?2(?: 0)?"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("bsl-1.0", "boost", "boost software"),
    ("zlib", "zlib", "zlib|zlib libpng"),
    ("libpng", "libpng", "libpng"),
    ("openssl", "openssl", "openssl"),
    ("python-2.0", "python", "python(?: software foundation)?"),
    ("php-3.01", "php", "php(?: license)?(?: version)? 3 01"),
    ("ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-4.0", "commons", "creative commons attribution(?: license)? (?:version )?4 0"),
    ("cc-by-sa-4.0", "commons", "creative commons attribution share(?: )?alike 4 0"),
    ("cc-by-nc", "commons", "creative commons attribution non(?: )?commercial"),
    ("cc-by-nd", "commons", "creative commons attribution no(?: )?deriv(?:s|atives)"),
    ("cc-by", "commons", "creative commons attribution"),
    ("odbl-1.0", "database", "open (?:data commons open )?database"),
    ("ofl-1.1", "font", "sil open font"),
    ("ncsa", "ncsa", "university of illinois ncsa open source|ncsa"),
    ("upl-1.0", "permissive", "universal permissive"),
    ("elastic-2.0", "elastic", "elastic(?: license)? 2(?: 0)?"),
    ("sspl-1.0", "server", "server side public"),
    ("busl-1.1", "source", "business source"),
    ("proprietary", "commercial", "commercial"),
    ("proprietary", "end", "end user"),
)
#: Signatures written by hand, by label: (keyword, regex). Sentences that only one licence, or one kind of notice, has.
SENTENCES = {
    "mit": (
        ("granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("restriction", "to deal in the software without restriction including without limitation the rights"),
        ("sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
        ("substantial", "shall be included in all copies or substantial portions of the software"),
        ("noninfringement", "fitness for a particular purpose and noninfringement"),
        ("mit", "see the mit licen[cs]e"),
        ("mit", "opensource org licenses mit"),
        ("mit", "choosealicense com licenses mit"),
        ("mit", "mit licensed"),
    ),
    "mit-0": (("attribution", "mit no attribution"),),
    "x11": (("consortium", "the name of the x consortium shall not be used in advertising"),),
    "isc": (
        ("granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("isc", "opensource org licenses isc"),
        ("systems", "internet systems consortium licen[cs]e"),
    ),
    "0bsd": (("disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),),
    "bsd": (
        ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("redistributions", "redistributions of source code must retain the above copyright notice"),
        ("redistributions", "redistributions in binary form must reproduce the above copyright notice"),
        ("bsd", "opensource org licenses bsd(?: license)?"),
        ("bsd", "use of this source code is governed by a bsd style licen[cs]e"),
        ("regents", "copyright (?:c )?.{0,40}?the regents of the university of california"),
    ),
    "bsd-2-clause": (("freebsd", "should not be interpreted as representing official policies either expressed or implied of the freebsd project"), ("bsd", "opensource org licenses bsd 2 clause")),
    "bsd-3-clause": (("endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse"), ("endorse", "may not be used to endorse or promote products derived from this software without specific prior written permission"), ("bsd", "opensource org licenses bsd 3 clause")),
    "bsd-4-clause": (("advertising", "all advertising materials mentioning features or use of this software must display"),),
    "apache-2.0": (
        ("compliance", "you may not use this file except in compliance with the license"),
        ("apache", "apache org licenses license 2 0"),
        ("apache", "apache license version 2 0 january 2004"),
        ("apache", "opensource org licenses apache 2 0"),
        ("contributor", "perpetual worldwide non exclusive no charge royalty free irrevocable .{0,40}?licen[cs]e to .{0,80}?contributor"),
        ("governing", "see the license for the specific language governing permissions and limitations under the license"),
    ),
    "apache": (("apache", "licensed to the apache software foundation asf under one or more contributor license agreements"), ("apache", "this product includes software developed (?:by|at) the apache software foundation")),
    "gpl": (
        ("redistribute", "this program is free software you can redistribute it and or modify"),
        ("foundation", "published by the free software foundation"),
        ("gnu", "you should have received a copy of the gnu general public license"),
        ("gnu", "under the terms of the gnu general public license"),
        ("copyleft", "the gnu general public license is a free copyleft license"),
        ("gnu", "gnu org licenses gpl"),
        ("everyone", "everyone is permitted to copy and distribute verbatim copies of this license document"),
        ("merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"),
    ),
    "gpl-2.0": (("june", "gnu general public license version 2 june 1991"), ("gpl", "gnu org licenses (?:old licenses )?gpl 2 0"), ("franklin", "51 franklin st(?:reet)? fifth floor boston")),
    "gpl-2.0-only": (("only", "gpl (?:version |v)?2(?: 0)? only|version 2 (?:of the license )?only"),),
    "gpl-2.0-or-later": (("option", "version 2 of the license or at your option any later version"), ("later", "gpl (?:version |v)?2(?: 0)? or later")),
    "gpl-3.0": (("june", "gnu general public license version 3 29 june 2007"), ("gpl", "gnu org licenses gpl 3 0"), ("propagate", "to propagate a work means to do anything with it that without permission")),
    "gpl-3.0-or-later": (("option", "version 3 of the license or at your option any later version"), ("later", "gpl (?:version |v)?3(?: 0)? or later")),
    "gpl-classpath": (("classpath", "classpath exception"), ("linking", "linking this library statically or dynamically with other modules is making a combined work")),
    "lgpl": (("library", "this library is free software you can redistribute it and or modify"), ("lesser", "you should have received a copy of the gnu lesser general public license"), ("lgpl", "gnu org (?:licenses|copyleft) (?:old licenses )?(?:lgpl|lesser)")),
    "lgpl-2.1": (("lesser", "gnu lesser general public license version 2 1"), ("february", "version 2 1 february 1999")),
    "lgpl-3.0": (("lesser", "gnu lesser general public license version 3"),),
    "agpl-3.0": (("affero", "gnu affero general public license version 3"), ("agpl", "gnu org licenses agpl(?: 3 0)?"), ("affero", "you should have received a copy of the gnu affero general public license"), ("remotely", "all users interacting with it remotely through a computer network")),
    "gfdl": (("invariant", "with no invariant sections no front cover texts and no back cover texts"), ("fdl", "gnu org licenses fdl")),
    "mpl-2.0": (("mozilla", "this source code form is subject to the terms of the mozilla public license"), ("mozilla", "mozilla org mpl 2 0"), ("mpl", "if a copy of the mpl was not distributed with this file")),
    "mpl-1.1": (("mozilla", "the contents of this file are subject to the mozilla public license version 1 1"), ("mozilla", "mozilla org mpl mpl 1 1")),
    "npl": (("netscape", "netscape public licen[cs]e"),),
    "epl-1.0": (("eclipse", "eclipse org legal epl v10"), ("agreement", "this eclipse public license agreement")),
    "epl-2.0": (("eclipse", "eclipse org legal epl (?:2 0|v20)"), ("eclipse", "eclipse public license v(?: )?2 0 which accompanies this distribution")),
    "edl-1.0": (("eclipse", "eclipse distribution licen[cs]e"),),
    "cddl-1.0": (("cddl", "cddl(?: version)? 1 0"), ("cddl", "opensource org licenses cddl(?: 1 0)?"), ("distribution", "common development and distribution license the license you may not use this file")),
    "cddl": (("cddl", "cddl"),),
    "cpl": (("cpl", "cpl 1 0|cpl v1 0"),),
    "ibm-pl": (("ibm", "ibm public licen[cs]e"),),
    "eupl-1.2": (("eupl", "eupl (?:version |v)?1 2"), ("eupl", "joinup ec europa eu .{0,40}?eupl")),
    "eupl": (("eupl", "eupl"),),
    "cecill": (("cecill", "cecill(?: [bc])?(?: licen[cs]e)?"),),
    "osl-3.0": (("osl", "osl 3 0"), ("open", "open software license (?:version |v)?3 0")),
    "afl-3.0": (("academic", "academic free license (?:version |v)?3 0"), ("afl", "afl 3 0")),
    "artistic": (("artistic", "same terms as perl .{0,30}?artistic"), ("perl", "you can redistribute it and or modify it under the same terms as perl itself"), ("artistic", "perl foundation org artistic licen[cs]e")),
    "bsl-1.0": (("boost", "distributed under the boost software license version 1 0"), ("boost", "boost org license 1 0 txt")),
    "zlib": (("altered", "altered source versions must be plainly marked as such"), ("origin", "the origin of this software must not be misrepresented"), ("freely", "to alter it and redistribute it freely subject to the following restrictions")),
    "openssl": (("openssl", "this product includes software developed by the openssl project"), ("ssleay", "ssleay licen[cs]e")),
    "curl": (("curl", "curl licen[cs]e|curl haxx se docs copyright"),),
    "icu": (("unicode", "unicode org copyright|unicode license v3"), ("icu", "icu licen[cs]e")),
    "ijg": (("jpeg", "this software is based in part on the work of the independent jpeg group"),),
    "freetype": (("freetype", "portions of this software are copyright .{0,40}?the freetype project"), ("ftl", "freetype license ftl")),
    "python-2.0": (("psf", "psf license agreement"), ("python", "python software foundation license version 2"), ("python", "python org psf license")),
    "php-3.01": (("php", "this product includes php software freely available from"), ("php", "php net license 3 01")),
    "ruby": (("ruby", "same terms as ruby|ruby s licen[cs]e"),),
    "tcl": (("tcl", "tcl tk licen[cs]e"),),
    "vim": (("vim", "vim licen[cs]e"),),
    "w3c": (("w3c", "w3c software (?:notice and )?(?:license|document)"),),
    "postgresql": (("documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),),
    "hpnd": (("hpnd", "hpnd"), ("historical", "historical permission notice and disclaimer")),
    "ntp": (("ntp", "ntp licen[cs]e"),),
    "ms-pl": (("pl", "ms pl"),),
    "ms-rl": (("rl", "ms rl"),),
    "ms-eula": (("microsoft", "microsoft software license terms"),),
    "unlicense": (("unencumbered", "this is free and unencumbered software released into the public domain"), ("unlicense", "unlicense org"), ("anyone", "anyone is free to copy modify publish use compile sell or distribute this software")),
    "public-domain": (("domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"), ("domain", "(?:is|are) in the public domain"), ("domain", "public domain dedication"), ("disclaims", "the author disclaims copyright to this source code"), ("waives", "waives all (?:copyright|rights)")),
    "cc0-1.0": (("publicdomain", "creativecommons org publicdomain zero 1 0"), ("cc0", "to the extent possible under law .{0,60}?waived all copyright .{0,120}?cc0")),
    "cc-by": (("creativecommons", "creativecommons org licenses by [0-9] [0-9]"), ("cc", "cc by(?: [0-9] [0-9])?")),
    "cc-by-sa": (("creativecommons", "creativecommons org licenses by sa [0-9] [0-9]"), ("cc", "cc by sa(?: [0-9] [0-9])?")),
    "cc-by-nc": (("creativecommons", "creativecommons org licenses by nc [0-9] [0-9]"), ("cc", "cc by nc(?: [0-9] [0-9])?")),
    "cc-by-nd": (("creativecommons", "creativecommons org licenses by nd [0-9] [0-9]"), ("cc", "cc by nd(?: [0-9] [0-9])?")),
    "cc-by-nc-sa": (("creativecommons", "creativecommons org licenses by nc sa [0-9] [0-9]"), ("cc", "cc by nc sa(?: [0-9] [0-9])?")),
    "cc-by-nc-nd": (("creativecommons", "creativecommons org licenses by nc nd [0-9] [0-9]"), ("cc", "cc by nc nd(?: [0-9] [0-9])?")),
    "creative-commons": (("commons", "licensed under (?:a|the) creative commons"), ("commons", "creative commons (?:public )?licen[cs]e")),
    "odbl-1.0": (("odbl", "odbl(?: 1 0)?"), ("opendatacommons", "opendatacommons org licenses odbl")),
    "odc-by": (("opendatacommons", "opendatacommons org licenses by"), ("attribution", "open data commons attribution")),
    "pddl": (("pddl", "pddl(?: 1 0)?"),),
    "ogl": (("government", "open government licen[cs]e"), ("crown", "crown copyright")),
    "ofl-1.1": (("font", "this font software is licensed under the sil open font license version 1 1"), ("ofl", "scripts sil org ofl"), ("reserved", "with reserved font name")),
    "wtfpl": (("fuck", "you just do what the fuck you want to"), ("fuck", "do what the fuck you want to public licen[cs]e")),
    "beerware": (("beer", "you can buy me a beer in return"), ("beerware", "the beerware licen[cs]e"), ("beer", "the beer ware licen[cs]e")),
    "json": (("evil", "the software shall be used for good not evil"),),
    "facebook-patents": (("patents", "an additional grant of patent rights can be found in the patents file"),),
    "elastic-2.0": (("elastic", "elastic co licensing elastic license"), ("managed", "you may not provide the software to third parties as a hosted or managed service")),
    "sspl-1.0": (("sspl", "sspl(?: v1| 1 0)?"), ("mongodb", "mongodb com licensing server side public license")),
    "busl-1.1": (("change", "change date .{0,40}?change license"), ("mariadb", "mariadb com bsl11")),
    "commons-clause": (("commons", "commons clause (?:license )?condition"), ("sell", "does not include the right to sell the software")),
    "polyform": (("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e"),),
    "llama": (("llama", "llama [0-9](?: [0-9])? community licen[cs]e"),),
    "openrail": (("openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?"), ("rail", "bigscience (?:bloom )?rail(?: licen[cs]e)?")),
    "no-warranty": (
        ("warranties", "without warranties or conditions of any kind"),
        ("warranty", "the software is provided as is without warranty of any kind"),
        ("warranties", "this software is provided (?:by .{1,80}? )?as is and any express or implied warranties"),
        ("warranty", "there is no warranty for the program to the extent permitted by applicable law"),
        ("liable", "in no event shall the authors? .{0,60}?be liable"),
        ("liable", "in no event shall the copyright (?:holders?|owners?) .{0,60}?be liable"),
        ("liable", "in no event (?:will|shall) the authors? be held liable"),
        ("warranty", "comes with absolutely no warranty"),
        ("warranty", "but without any warranty"),
        ("risk", "use (?:it )?at your own risk"),
        ("guarantee", "provided without (?:any )?guarantee"),
    ),
    "all-rights-reserved": (("reserved", "all rights reserved"), ("reservados", "todos los derechos reservados"), ("vorbehalten", "alle rechte vorbehalten"), ("réservés", "tous droits réservés")),
    "copyright": (("copyright", "copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})?"), ("copr", "copr [12][0-9]{3}"), ("copyright", "copyright (?:is )?held by|copyright owner")),
    "proprietary": (
        ("confidential", "proprietary and confidential|confidential and proprietary"),
        ("unauthorized", "unauthorized (?:copying|reproduction|distribution|use)"),
        ("prohibited", "(?:copying|reproduction|redistribution) .{0,60}?is (?:strictly )?prohibited"),
        ("written", "without (?:the )?(?:express |prior )*written (?:consent|permission) of"),
        ("trade", "contains trade secrets"),
        ("unpublished", "unpublished (?:work|proprietary source code)"),
        ("internal", "for internal use only"),
        ("evaluation", "for evaluation purposes only"),
        ("eula", "eula"),
        ("nda", "under (?:an )?nda"),
    ),
    "non-commercial": (("commercial", "(?:for )?non commercial (?:use|purposes) only"), ("noncommercial", "(?:for )?noncommercial (?:use|purposes) only"), ("research", "for research (?:use|purposes) only"), ("academic", "for academic (?:use|purposes) only"), ("educational", "for educational (?:use|purposes) only"), ("personal", "for personal use only")),
    "licence-reference": (
        ("details", "see the licen[cs]e(?: file)? for (?:more )?details"),
        ("accompanying", "accompanying (?:file )?licen[cs]e"),
        ("some", "some rights reserved"),
        ("root", "(?:in the )?licen[cs]e file in the root"),
        ("copying", "see (?:the file )?copying for"),
        ("notice", "see (?:the )?notice file"),
        ("included", "licen[cs]e .{0,20}?included (?:with|in) this (?:distribution|package|repository)"),
        ("dual", "dual licensed"),
        ("licensing", "licensing (?:information|terms)"),
        ("spdx", "spdx licen[cs]e identifier [a-z0-9]+(?: [a-z0-9]+){0,3}"),
    ),
    "terms-of-use": (("terms", "(?:subject to|agree to|accept) (?:the|our|these) terms of (?:use|service)"),),
    "attribution": (("attribution", "attribution (?:is )?required"), ("credit", "must give appropriate credit")),
}
#: Priorities: a name, a grant, a sentence, an identifier. Confidence of each.
CONFIDENCE = {1: 0.6, 2: 0.8, 3: 0.9, 4: 1.0}


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regex, priority); the regexes stand between spaces, with two spaces between words."""
    out = []
    for label, keyword, name in NAMES:
        ended = f"(?:{name})(?: (?:software |open source )?licen[cs]e)?"
        out += [
            (label, keyword, f"(?:{name}) (?:software |open source )?licen[cs]e(?:s|d)?", 1),
            (label, keyword, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{ended}", 2),
        ]
    for label in dict.fromkeys([*(x for x, _, _ in NAMES), *SENTENCES]):
        out.append((label, "spdx", f"spdx licen[cs]e identifier {label.replace('-', ' ').replace('.', ' ')}(?: only| or later)?", 4))
    out += [(label, keyword, rx, 3) for label, signatures in SENTENCES.items() for keyword, rx in signatures]
    return [(label, keyword, f" (?:{rx.replace(' ', '  ')}) ", priority) for label, keyword, rx, priority in out]


def keywords() -> list[str]:
    """The rules' keywords, one word each; a text with none of them can match no rule."""
    return sorted({keyword for _, keyword, _, _ in rules()})


def base_places(words: Column, norm: Column, phrase: str) -> Column:
    """Starts, in words from 0, of the places where a phrase's words stand consecutively."""
    parts = phrase.split(" ")
    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(parts)),
        lambda i: _all(*[F.element_at(words, i + 1 + k) == p for k, p in enumerate(parts)]),
    )
    return F.when(F.contains(norm, F.lit("  ".join(["", *parts])[1:] + " ")), places).otherwise(F.array().cast("array<int>"))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def detections(norm: Column, have: Column) -> Column:
    """Array of (start, minus end, minus priority, label) of every rule's matches, sorted; have: the keywords in the text."""
    table = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(k).alias("word"), F.lit(rx).alias("rx"), F.lit(p).alias("p")) for a, k, rx, p in rules()])
    tried = F.filter(table, lambda r: F.array_contains(have, r["word"]))

    def places(r: Column) -> Column:
        # split and matches have one order: a match starts where the parts and matches before it end
        both = F.arrays_zip(F.split(norm, r["rx"], -1).alias("gap"), F.regexp_extract_all(norm, r["rx"], F.lit(0)).alias("hit"))
        none = F.array().cast("array<struct<s:int,e:int>>")
        got = F.aggregate(
            F.filter(both, lambda x: x["hit"].isNotNull()),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("s"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("e")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return F.transform(got, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), (-r["p"]).alias("p"), r["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(tried, places)))


def kept(found: Column) -> Column:
    """Of sorted detections, those not within an earlier one of the same or a higher priority."""
    levels = sorted(CONFIDENCE)
    none = F.array().cast("array<struct<p:int,label:string>>")
    reach = [F.lit(-1).alias(f"e{p}") for p in levels]  # how far detections of at least this priority reach

    def step(acc: Column, d: Column) -> Column:
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((-d["p"] == p) & (acc[f"e{p}"] >= -d["e"]))
        ends = [F.when(-d["p"] >= p, F.greatest(acc[f"e{p}"], -d["e"])).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels]
        more = F.when(inside, acc["out"]).otherwise(F.array_union(acc["out"], F.array(F.struct((-d["p"]).alias("p"), d["label"].alias("label")))))
        return F.struct(*ends, more.alias("out"))

    return F.aggregate(found, F.struct(*reach, none.alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, words, plain places and their labels, all labels, score (0 to 1)."""
    d = docs.select(column(id_col).alias("id"), F.translate(F.coalesce(column(text_col), F.lit("")), UPPER, LOWER).alias("t"))
    d = d.select("id", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"))
    d = d.select("id", "words", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("norm"))
    # one look-up a word, whatever the number of rules
    have = F.array_intersect(F.col("words"), F.array(*map(F.lit, keywords())))
    d = d.select("id", F.size("words").cast("long").alias("n_words"), "words", "norm", have.alias("have"))
    d = d.select("id", "n_words", *[F.when(F.size("have") > 0, F.col(c)).alias(c) for c in ("words", "norm", "have")])
    empty = F.array().cast("array<int>")
    d = d.select(
        "id", "n_words", *[F.coalesce(base_places(F.col("words"), F.col("norm"), p), empty).alias(f"at{k}") for k, (p, _) in enumerate(PHRASES)],
        F.coalesce(kept(detections(F.col("norm"), F.col("have"))), F.array().cast("array<struct<p:int,label:string>>")).alias("kept"),
    )
    places = F.concat(*[F.col(f"at{k}") for k in range(len(PHRASES))])
    labels = F.filter(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(v)) for k, (_, v) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    d = d.select("id", "n_words", places.alias("places"), labels.alias("base"), "kept")
    score = F.aggregate("kept", F.when(F.size("base") > 0, F.lit(CONFIDENCE[1])).otherwise(F.lit(0.0)), lambda a, x: F.greatest(a, F.element_at(F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv]), x["p"])))
    return d.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("kept", lambda x: x["label"]))), ",").alias("labels"),
        score.alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ",".join(f"({n},{quote(a)},{quote(k)},{quote(rx)},{p})" for n, (a, k, rx, p) in enumerate(rules()))
    at = ",".join(
        "list_filter(range(len(words)), lambda i: " + " and ".join(f"words[i+{k + 1}] = {quote(p)}" for k, p in enumerate(phrase.split())) + f") as at{n}"
        for n, (phrase, _) in enumerate(PHRASES)
    )
    base = "list_filter([" + ",".join(f"case when len(at{n}) > 0 then {quote(v)} end" for n, (_, v) in enumerate(PHRASES)) + "], lambda x: x is not null)"
    conf = "case p " + " ".join(f"when {p} then {c}" for p, c in CONFIDENCE.items()) + " end"
    return f"""
with rules(r, label, word, rx, p) as (values {table}),
d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') words from documents),
n as (select *, ' ' || array_to_string(words, '  ') || ' ' norm from d),
b as (select rid, doc_id, len(words) n_words, {at} from n),
b2 as (select rid, doc_id, n_words, list_concat(list_concat(at0, at1), at2) places, {base} base from b),
hits as (select rid, r, label, p, regexp_extract_all(norm, rx) hit, string_split_regex(norm, rx) gap from n join rules on list_contains(words, word)),
each as (select rid, r, label, p, k, len(hit[k]) w, list_sum(list_transform(gap[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(hit[1:k-1], lambda x: len(x))), 0) s
         from hits, unnest(range(1, len(hit) + 1)) u(k)),
span as (select rid, label, p, s, s + w e from each),
seen as (select *, max(case when p >= 1 then e end) over o e1, max(case when p >= 2 then e end) over o e2, max(case when p >= 3 then e end) over o e3, max(case when p >= 4 then e end) over o e4
         from span window o as (partition by rid order by s, e desc, p desc, label rows between unbounded preceding and 1 preceding)),
kept as (select rid, list(distinct label) labels, max({conf}) c from seen where coalesce(case p when 1 then e1 when 2 then e2 when 3 then e3 else e4 end, -1) < e group by rid)
select doc_id, cast(n_words as bigint) n_words, cast(len(places) as bigint) n_base, cast(list_min(places) as bigint) first_word, cast(list_max(places) as bigint) last_word,
       array_to_string(list_sort(base), ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') labels,
       cast(greatest(coalesce(c, 0), case when len(base) > 0 then {CONFIDENCE[1]} else 0 end) as double) score
from b2 left join kept using (rid)"""
