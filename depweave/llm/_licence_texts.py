"""Known licences. Public licence texts, notices and equivalent spellings."""

import re
import textwrap
from pathlib import Path

#: Equivalent words, as in the matching guidelines for licence lists.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub licence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfilment", "fulfillment"), ("modernise", "modernize"), ("organisation", "organization"), ("programme", "program"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("per cent", "percent"), ("while", "whilst"), ("wilful", "willful"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_NOTICE = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""

#: SPDX name, title, text.
TEXTS = [
    ("MIT", "MIT License", _MIT + _MIT_NOTICE + _AS_IS),
    ("MIT-0", "MIT No Attribution", _MIT + "." + _AS_IS),
    ("ISC", "ISC License", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("0BSD", "BSD Zero Clause License", _ISC + "." + _ISC_END),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD + _BSD_THIRD + _BSD_END),
    ("Zlib", "zlib License", _ZLIB),
    ("Apache-2.0", "Apache License, Version 2.0", _APACHE),
    ("GPL-2.0-or-later", "GNU General Public License", _GPL.format(v=2)),
    ("GPL-3.0-or-later", "GNU General Public License", _GPL.format(v=3)),
    ("MPL-2.0", "Mozilla Public License 2.0", _MPL),
    ("WTFPL", "Do What The Fuck You Want To Public License", _WTFPL),
]

#: Other titles that a text of TEXTS stands below.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "(The MIT License)"],
    "MIT-0": ["MIT-0", "MIT No Attribution License"],
    "ISC": ["The ISC License", "ISC", "The ISC License (ISC)", "ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "0BSD", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["The BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["The BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "BSD License", "The BSD License", "Modified BSD License"],
    "Zlib": ["The zlib License", "zlib", "The zlib/libpng License"],
    "Apache-2.0": ["Apache License 2.0", "The Apache License, Version 2.0", "Apache-2.0", "Apache 2.0", "Apache License"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0-or-later", "GNU GPL"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0-or-later", "GNU GPL"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL-2.0", "MPL 2.0"],
    "WTFPL": ["WTFPL"],
}
#: Stands below the copyright line of many texts.
RESERVED = "All rights reserved."
#: Where the terms of a whole text end and advice on its use begins.
_END_OF_TERMS = re.compile(r"END OF TERMS AND CONDITIONS")


def layouts(text: str) -> list[str]:
    """A short text with its paragraphs on one line and wrapped at 60 to 100 characters, with and without the numbers of its items."""
    out = []
    for t in (text, re.sub(r"(?m)^\d\. ", "", text)):
        paragraphs = t.split("\n\n")
        out += [t, *["\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs) for width in range(60, 101)]]
    return out


def whole_texts() -> list[tuple[str, str]]:
    """SPDX name and text of the complete licences beside this file.

    Each as it stands, with its lines joined to paragraphs (a line that begins with "copyright" is left out of digests, so wrapping
    matters), and both without what follows its terms.
    """
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        end = _END_OF_TERMS.search(text)
        for part in [text, *([text[: end.end()], text[: end.start()]] if end else [])]:
            out += [(path.stem, part), (path.stem, re.sub(r"(?<!\n)\n[ \t]*(?=[^\s])", " ", part))]
    return out


#: Notices of one line.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC0-1.0": ["This work is dedicated to the public domain under the CC0 1.0 Universal license.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0-only": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This work is licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}

#: The six Creative Commons licences of version 4.0: the parts of the long name of each.
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _short, _long in _CC.items():
    _names = [f"CC {_short} 4.0", f"CC-{_short}-4.0", f"Creative Commons {_long} 4.0", f"Creative Commons {_long} 4.0 International"]
    _leads = ["Licensed under", "This work is licensed under", "This project is licensed under"]
    NOTICES[f"CC-{_short}-4.0"] = [
        *[f"{lead} {article}{name}{end}." for lead in _leads for article in ("", "a ", "the ") for name in _names for end in ("", " License")],
        *[f"Released under {article}{name} License." for article in ("", "a ", "the ") for name in _names],
        f"SPDX-License-Identifier: CC-{_short}-4.0",
    ]
