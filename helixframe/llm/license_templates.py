"""Templates of licences: names, notices, headers and whole texts.

A licence is named in many ways; NAMES maps each to one token, so that an SPDX
identifier, a title and a name in a sentence are the same word of a vector. FRAMES are
sentences around a name. The whole texts of the longer licences are in ``license_texts``.
"""

from __future__ import annotations

from importlib import resources

_V = r"(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?"
_SUFFIX = r"(?:[- ]only|[- ]or-later)?"
_END = r"(?![\w.+-])"
_AFTER = r"\b(?:(?<=identifier )|(?<=license )|(?<=licence )|(?<=under )|(?<=under the ))"
#: Patterns over lower-case words parted by single spaces, in the order they are applied.
NAMES = {
    "AGPL-3.0": rf"\b(?:gnu )?affero general public licen[cs]e{_V}3(?:\.0)?{_END}|\b(?:gnu )?agpl[- ]?v?3(?:\.0)?{_SUFFIX}{_END}",
    "LGPL-3.0": rf"\b(?:gnu )?lesser general public licen[cs]e{_V}3(?:\.0)?{_END}|\b(?:gnu )?lgpl[- ]?v?3(?:\.0)?{_SUFFIX}{_END}",
    "LGPL-2.1": rf"\b(?:gnu )?lesser general public licen[cs]e{_V}2\.1{_END}|\b(?:gnu )?lgpl[- ]?v?2\.1{_SUFFIX}{_END}",
    "GPL-3.0": rf"\b(?<!lesser )(?<!affero )(?<!library )(?:gnu )?general public licen[cs]e{_V}3(?:\.0)?{_END}|\b(?:gnu )?gpl[- ]?v?3(?:\.0)?{_SUFFIX}{_END}",
    "GPL-2.0": rf"\b(?<!lesser )(?<!affero )(?<!library )(?:gnu )?general public licen[cs]e{_V}2(?:\.0)?{_END}|\b(?:gnu )?gpl[- ]?v?2(?:\.0)?{_SUFFIX}{_END}",
    "Apache-2.0": rf"\bapache(?: software)?(?: public)? licen[cs]e(?: version| v)? ?v?2(?:\.0)?{_END}|\basl[- ]?2\.0{_END}|\bapache[- ]?(?:version )?v?2(?:\.0)?{_END}(?: licen[cs]e\b)?",
    "BSD-2-Clause": rf"\b(?:(?:2|two)[- ]clause|simplified|freebsd) bsd(?: licen[cs]e\b)?|\bbsd[- ](?:2|two)[- ]clause(?:[- ](?:simplified|freebsd))?{_END}(?: licen[cs]e\b)?",
    "BSD-3-Clause": rf"\b(?:(?:3|three)[- ]clause|new|modified|revised) bsd(?: licen[cs]e\b)?|\bbsd[- ](?:3|three)[- ]clause{_END}(?: licen[cs]e\b)?",
    "CC-BY-NC-4.0": rf"\b(?:creative commons )?(?:cc[- ]by-nc[- ]4\.0|attribution[- ]non-?commercial 4\.0){_END}(?: international)?(?: public)?(?: licen[cs]e\b)?",
    "CC-BY-SA-4.0": rf"\b(?:creative commons )?(?:cc[- ]by-sa[- ]4\.0|attribution[- ]share-?alike 4\.0){_END}(?: international)?(?: public)?(?: licen[cs]e\b)?",
    "CC-BY-4.0": rf"\b(?:creative commons )?(?:cc[- ]by[- ]4\.0|attribution 4\.0){_END}(?: international)?(?: public)?(?: licen[cs]e\b)?",
    "CC0-1.0": rf"\b(?:creative commons )?(?:cc0|cc zero|zero)[- ](?:v?1\.0){_END}(?: universal)?(?: public domain dedication)?|\bcc0{_END}(?: public domain dedication)?",
    "ISC": rf"\bisc licen[cs]e(?: isc{_END})?|{_AFTER}isc{_END}",
    "MIT": rf"\b(?:mit|expat)(?: x11|[- ]style)? licen[cs]e(?: mit{_END})?|{_AFTER}(?:mit|expat){_END}|\bmit-licensed{_END}",
    "MPL-2.0": rf"\bmozilla public licen[cs]e(?: version| v)? ?v?2(?:\.0)?{_END}|\bmpl[- ]?v?2(?:\.0)?{_END}",
    "Unlicense": rf"\bunlicense{_END}",
}
FRAMES = (
    "{}",
    "{} license",
    "SPDX-License-Identifier: {}",
    "Licensed under {}.",
    "Released under the {}.",
    "This project is licensed under the {}.",
    "This software is released under the {}.",
    "Copyright (c) the authors. All rights reserved. Licensed under the {}.",
    "This file is part of the project and is distributed under the terms of the {}; see the LICENSE file for details.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} or (at your option) any later version.",
    "The source code is available under the {}, see the LICENSE file for the full text of the license.",
    "Use of this source code is governed by a {} that can be found in the LICENSE file.",
    "This library is made available as open source under the terms of the {}.",
)

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the {0}, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU_NAME = "GNU {}General Public License as published by the Free Software Foundation"

#: (licence, text): headers and whole texts, which no name need precede.
TEXTS = [
    ("MIT", _MIT),
    ("MIT", f'MIT License Copyright (c) {_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {_BSD}{_BSD3} {_AS_IS}"),
    ("ISC", _ISC),
    ("ISC", f'Copyright (c) {_ISC} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f'{_UNLICENSE} In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    *((i, _GNU.format(_GNU_NAME.format(n), v)) for i, n, v in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))),
]


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files of ``license_texts``."""
    return [(f.name, f.read_text(encoding="utf-8")) for f in sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name) if not f.name.startswith(".")]
