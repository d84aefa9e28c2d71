"""Known licence texts and notices, from their public wording."""

from __future__ import annotations

import pkgutil

#: The wording of short public licences and licence notices.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

KNOWN = {
    "MIT": "MIT License\n\n" + _MIT_GRANT,
    "MIT-untitled": _MIT_GRANT,
    "ISC": "ISC License\n\n" + _ISC_GRANT,
    "ISC-untitled": _ISC_GRANT,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL,
    "BSD-2-Clause-untitled": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "BSD-3-Clause-untitled": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": "zlib License\n\n" + _ZLIB,
    "Zlib-untitled": _ZLIB,
    "Apache-2.0-notice": _APACHE_NOTICE,
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-titled": "The MIT License (MIT)\n\n" + _MIT_GRANT,
    "MIT-titled-short": "The MIT License\n\n" + _MIT_GRANT,
    "MIT-licensed-line": "Licensed under the MIT License.",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-line": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "All-rights-reserved": "All rights reserved.",
}

#: The families that notices are spelled out for.
_GNU = {"GPL": ("General", ("1", "2", "3")), "LGPL": ("Lesser General", ("2.1", "3")), "LGPL-library": ("Library General", ("2",)), "AGPL": ("Affero General", ("3",))}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2
GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Unlicense WTFPL Zlib""".split()
for _tag in _SPDX:
    if not _tag.endswith("+"):
        KNOWN[f"SPDX-{_tag}"] = f"SPDX-License-Identifier: {_tag}"
for _id, (_name, _versions) in _GNU.items():
    for _v in _versions:
        KNOWN[f"{_id}-{_v}-line"] = f"licensed under the GNU {_name} Public License, version {_v}."
        KNOWN[f"{_id}-{_v}-or-later-notice"] = f"the terms of the GNU {_name} Public License as published by the Free Software Foundation; either version {_v} of the License, or (at your option) any later version."
        KNOWN[f"{_id}-{_v}-notice"] = f"the terms of the GNU {_name} Public License as published by the Free Software Foundation; version {_v} of the License."
        KNOWN[f"{_id}-{_v}-plain-notice"] = f"the terms of the GNU {_name} Public License version {_v} as published by the Free Software Foundation."
        KNOWN[f"{_id}-{_v}-comma-notice"] = f"the terms of the GNU {_name} Public License as published by the Free Software Foundation, version {_v}."
for _id, _name in _CC.items():
    for _v, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        KNOWN[f"CC-{_id}-{_v}-line"] = f"licensed under CC {_id} {_v}."
        KNOWN[f"CC-{_id}-{_v}-notice"] = f"licensed under a Creative Commons {_name} {_v} {_port} License."
        KNOWN[f"CC-{_id}-{_v}-the-notice"] = f"licensed under the Creative Commons {_name} {_v} {_port} License."
        KNOWN[f"CC-{_id}-{_v}-link"] = f"creativecommons.org/licenses/{_id.lower()}/{_v}"
KNOWN["CC0-1.0-link"] = "creativecommons.org/publicdomain/zero/1.0"

#: Whole licences, each in a file of this name under license_texts.
FILES = ("Apache-2.0", "Artistic-1.0", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")
_BEGIN, _END = "Everyone is permitted to copy", "END OF TERMS AND CONDITIONS"


def all_known() -> dict[str, str]:
    """KNOWN and the whole licences; of these also the wording without the
    title and the publisher's address, and without the appendix."""
    out = dict(KNOWN)
    for name in FILES:
        text = pkgutil.get_data("loomline.llm", f"license_texts/{name}.txt").decode()
        starts = {"": 0, "-untitled": max(0, text.find(_BEGIN))}
        ends = {"": len(text), "-terms": text.find(_END) + len(_END) if _END in text else len(text)}
        for a, i in starts.items():
            for b, j in ends.items():
                if (not a or i) and (not b or j < len(text)):
                    out[name + a + b] = text[i:j]
    return out
