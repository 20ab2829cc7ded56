"""Wording of licenses and of the notices that name them, with markup as in ``license_scan``.

Fixed values: what has to match is the licenses' own wording.
"""

from __future__ import annotations

#: Phrases that name a license, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

_GRANT = '<<beginOptional>>this <<any="work|software|project|program|package|library|file|code|document|material|text">> is <<endOptional>><<any="licensed|released|distributed|published|available|made available|provided">> under <<beginOptional>>the terms of <<endOptional>><<any="the|a|an|">> '
_COPYRIGHT = '<<beginOptional>>copyright <<beginOptional>>c <<endOptional>><<var;words="1-40">> <<endOptional>>'
_AS_IS_HOLDERS = '<<any="the copyright holders and contributors|the copyright holder and contributors|the author and contributors|the authors and contributors|the regents and contributors|the author|the authors">>'
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<any="1||a">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<any="2||b">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """<<any="3||c">> Neither the name of <<var;words="1-30">> nor the names of <<any="its|his|her|their|the">> contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_BSD_END = f"""THIS SOFTWARE IS PROVIDED BY {_AS_IS_HOLDERS} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, later: bool) -> list[str]:
    """A notice of a GNU license, short and as its text proposes it."""
    dotted = f'<<any="v{version}|version {version}|v {version}">>'
    if later:
        return [
            f'{_GRANT}<<beginOptional>>gnu <<endOptional>>{name} {dotted} or <<beginOptional>>at your option <<endOptional>><<any="any later version|later">>',
            f"under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version",
        ]
    return [
        f'{_GRANT}<<beginOptional>>gnu <<endOptional>>{name} {dotted}<<beginOptional>> only<<endOptional>>',
        f"under the terms of the gnu {name} <<beginOptional>>version {version} <<endOptional>>as published by the free software foundation version {version}<<beginOptional>> of the license<<endOptional>>",
    ]


def _commons(parts: str) -> list[str]:
    """Notices of a Creative Commons license, by letters and in words."""
    long = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    spelt = " ".join(f'<<any="{long[p]}|{long[p].replace("non", "non ").replace("share", "share ").replace("noder", "no der")}">>' for p in parts.split())
    return [f"{_GRANT}cc {parts} 4 0<<beginOptional>> license<<endOptional>>", f'{_GRANT}creative commons {spelt} 4 0 <<any="international||international public">> license']


#: Templates by label (SPDX identifiers).
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        f"{_GRANT}mit license",
        f"""<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_COPYRIGHT}<<beginOptional>>All rights reserved.<<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Apache-2.0": [
        f'{_GRANT}apache license <<any="v2|version 2|v 2">><<beginOptional>> 0<<endOptional>>',
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<any="file|work|software|project">> except in compliance with the License. You may obtain a copy of the License at
<<var;words="1-12">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": [f"{_COPYRIGHT}<<beginOptional>>All rights reserved.<<endOptional>> {_BSD_TWO}{_BSD_END}", f'{_GRANT}<<any="bsd 2 clause|2 clause bsd|simplified bsd">> license'],
    "BSD-3-Clause": [f"{_COPYRIGHT}<<beginOptional>>All rights reserved.<<endOptional>> {_BSD_TWO}{_BSD_THIRD}{_BSD_END}", f'{_GRANT}<<any="bsd 3 clause|3 clause bsd|new bsd|modified bsd">> license'],
    "ISC": [
        f"{_GRANT}isc license",
        f"""{_COPYRIGHT}Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1-12">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ],
    "MPL-2.0": [
        f'{_GRANT}mozilla public license <<any="v|version">> 2 0',
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;words=\"1-10\">>",
    ],
    "GPL-2.0-only": _gnu("general public license", "2", False),
    "GPL-2.0-or-later": _gnu("general public license", "2", True),
    "GPL-3.0-only": _gnu("general public license", "3", False),
    "GPL-3.0-or-later": _gnu("general public license", "3", True),
    "LGPL-2.1-only": _gnu("lesser general public license", "2 1", False),
    "LGPL-2.1-or-later": _gnu("lesser general public license", "2 1", True),
    "LGPL-3.0-only": _gnu("lesser general public license", "3", False),
    "LGPL-3.0-or-later": _gnu("lesser general public license", "3", True),
    "AGPL-3.0-only": _gnu("affero general public license", "3", False),
    "AGPL-3.0-or-later": _gnu("affero general public license", "3", True),
    "CC-BY-4.0": _commons("by"),
    "CC-BY-SA-4.0": _commons("by sa"),
    "CC-BY-NC-4.0": _commons("by nc"),
    "CC-BY-ND-4.0": _commons("by nd"),
    "CC-BY-NC-SA-4.0": _commons("by nc sa"),
    "CC-BY-NC-ND-4.0": _commons("by nc nd"),
    "CC0-1.0": [f"{_GRANT}cc0 1 0<<beginOptional>> universal<<endOptional>>", "to the extent possible under law <<var;words=\"1-20\">> waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
# A file's tag names its license in one line.
for _label, _several in TEMPLATES.items():
    _several.append(f"SPDX License Identifier {_label}")
