"""Notices and texts of public licences, as lower-case words, with the phrases that tell each from its kin."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """label, words in their order, and the phrases that must stand in it. whole: every word must stand, one after the other."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    whole: bool = False


# The contract's phrases and their labels.
BASE = (
    Template("cc-by", "cc by", whole=True),
    Template("gpl", "general public license", whole=True),
    Template("reserved", "all rights reserved", whole=True),
)

_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_REDISTRIBUTION = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_HOLDERS = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

# Label | words | mandatory phrases, parted by slashes.
_TEXTS = f"""
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | permission is hereby granted free of charge / associated documentation files
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_DISCLAIMER} | to deal in the software without restriction / shall be included in all copies or substantial portions of the software
mit | released under the mit license | mit license
mit | licensed under the mit license | mit license
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so {_DISCLAIMER} | is furnished to do so the software is provided as is
x11 | except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium | the name of the x consortium shall not be used in advertising
apache-2.0 | licensed under the apache license version 2 0 | apache license version 2 0
apache-2.0 | apache license version 2 0 january 2004 | apache license / version 2 0 january 2004
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license | distributed on an as is basis / governing permissions and limitations under the license
apache-1.1 | the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation | software developed by the apache software foundation
gpl-2.0 | this work is licensed under the gnu general public license version 2 | gnu general public license version 2
gpl-3.0 | this work is licensed under the gnu general public license version 3 | gnu general public license version 3
gpl-notice | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation | gnu general public license / free software foundation
gpl-notice | you should have received a copy of the gnu general public license along with this program if not write to the free software foundation | copy of the gnu general public license
gpl-3.0 | the gnu general public license is a free copyleft license for software and other kinds of works | free copyleft license for software and other kinds of works
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license | gnu lesser general public license
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license | gnu library general public license
agpl-3.0 | licensed under the gnu affero general public license version 3 | gnu affero general public license
agpl-3.0 | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation | gnu affero general public license as published
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | gnu free documentation license
bsd | {_REDISTRIBUTION} | redistribution and use in source and binary forms / following conditions are met
bsd-2-clause | {_REDISTRIBUTION} {_HOLDERS} this software is provided by the copyright holders and contributors as is and any express or implied warranties | provided with the distribution this software is provided by the copyright holders
bsd-3-clause | {_HOLDERS} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission | may be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by | all advertising materials mentioning features or use of this software
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties | without fee is hereby granted the software is provided as is
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to use copy modify / without fee is hereby granted
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness | this permission notice appear in all copies
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation | this permission notice appear in supporting documentation
ntp | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation | appears in all copies and that both the copyright notice
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1 you may not use this file except in compliance with the license | mozilla public license version 1 1
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0 | mozilla public license
epl-1.0 | all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution | eclipse public license v1 0
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 | eclipse public license
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license | common development and distribution license
cpl-1.0 | the accompanying program is provided under the terms of this common public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement | this common public license
ipl-1.0 | the accompanying program is provided under the terms of this ibm public license agreement | ibm public license
eupl-1.2 | licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl | european commission subsequent versions of the eupl
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages | in no event will the authors be held liable
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software | altered source versions must be plainly marked as such
libpng | the png reference library is supplied as is the contributing authors and group 42 inc disclaim all warranties expressed or implied | the png reference library is supplied as is
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software | any person or organization obtaining a copy
bsl-1.0 | distributed under the boost software license version 1 0 | boost software license
unlicense | this is free and unencumbered software released into the public domain | free and unencumbered software
unlicense | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed | changing it is allowed as long as the name is changed
beerware | as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer in return | buy me a beer in return
json | the software shall be used for good not evil | shall be used for good not evil
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package | some semblance of artistic control
artistic-2.0 | licensed under the terms of the artistic license 2 0 | artistic license 2 0
perl | this library is free software you may redistribute it and or modify it under the same terms as perl itself | under the same terms as perl itself
psf-2.0 | this license agreement is between the python software foundation and the individual or organization accessing and otherwise using this software in source or binary form and its associated documentation | the python software foundation
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies | this paragraph and the following two paragraphs appear in all copies
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | the openssl project for use in the openssl toolkit
ssleay | this product includes cryptographic software written by eric young | cryptographic software written by
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind | appear in all copies the software is provided as is without warranty
ncsa | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimers in the documentation | this list of conditions and the following disclaimers
ofl-1.1 | this font software is licensed under the sil open font license version 1 1 | sil open font license
ms-pl | this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software | this license governs use of the accompanying software
ms-pl | licensed under the microsoft public license | microsoft public license
ms-rl | licensed under the microsoft reciprocal license | microsoft reciprocal license
afl-3.0 | licensed under the academic free license version 3 0 | academic free license version 3 0
osl-3.0 | licensed under the open software license version 3 0 | open software license version 3 0
odbl-1.0 | this database is made available under the open database license any rights in individual contents of the database are licensed under the database contents license | open database license
odc-by-1.0 | this database is made available under the open data commons attribution license | open data commons attribution license
pddl-1.0 | this database is made available under the public domain dedication and license v1 0 | public domain dedication and license
qpl-1.0 | licensed under the q public license version 1 0 | q public license
w3c | this work is being provided by the copyright holders under the following license by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions | you have read understood and will comply
upl-1.0 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights in the software | subject to the condition set forth below permission is hereby granted
vim | there are no restrictions on distributing unmodified copies of vim except that they must include this license text | no restrictions on distributing unmodified copies of vim
sspl-1.0 | licensed under the server side public license version 1 | server side public license
busl-1.1 | use of the licensed work is governed by the business source license included in this repository | business source license
elastic-2.0 | licensed under the elastic license 2 0 you may not use this file except in compliance with the elastic license 2 0 | elastic license 2 0
mulan-2.0 | this software is licensed under the mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2 | mulan psl v2
cecill-2.1 | this software is governed by the cecill license under french law and abiding by the rules of distribution of free software | the cecill license under french law
llama | this model is licensed under the llama community license agreement | llama community license
openrail | licensed under the creativeml open rail m license with use based restrictions | open rail m
cc0 | the person who associated a work with this deed has dedicated the work to the public domain | dedicated the work to the public domain
cc0 | to the extent possible under law the author has waived all copyright and related or neighboring rights to this work | waived all copyright and related or neighboring rights
cc-by | licensed under cc by 4 0 | cc by 4 0
cc-by-sa | licensed under cc by sa 4 0 | cc by sa
cc-by-nc | licensed under cc by nc 4 0 | cc by nc
cc-by-nd | licensed under cc by nd 4 0 | cc by nd
"""


def _creative_commons() -> list[Template]:
    """The six attribution licences in their versions, by their names."""
    words = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
    out = []
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        for version, place in (("2.0", "generic"), ("2.5", "generic"), ("3.0", "unported"), ("4.0", "international")):
            name = f"{' '.join(words[k] for k in kind.split('-'))} {version.replace('.', ' ')} {place}"
            out.append(Template(f"cc-{kind}-{version}", f"this work is licensed under a creative commons {name} license", (name,)))
    return out


TEMPLATES = (*(Template(label.strip(), text.strip(), tuple(p.strip() for p in phrases.split("/"))) for label, text, phrases in (line.split("|") for line in _TEXTS.strip().splitlines())), *_creative_commons())
