"""Notices of public licenses by identifier, the words they must have and those they must not pass over.

A whole notice has the plain identifier, its copyright line left out. The first sentences of a
notice, which often stand alone, are named ``-opening``, one with a link but without a postal
address ``-link``, a one-line mention ``-notice``."""

from __future__ import annotations

_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
          "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
          "AUTHORS {holders}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so")
_MIT_OPENING = (_MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be "
                "included in all copies or substantial portions of the Software.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted")
_ISC_OPENING = _ISC + ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (" THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
            "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
            "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
            "USE OR PERFORMANCE OF THIS SOFTWARE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
           "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
           "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
           "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.")
_BSD_3 = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.")
_BSD_4 = (" All advertising materials mentioning features or use of this software must display the following acknowledgement: "
          "This product includes software developed by the organization.")
_BSD_END = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
            "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
            "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
            "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
            "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
            "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_UNLICENSE = "This is free and unencumbered software released into the public domain."

#: fixed values: the notices
TEMPLATES = {
    "MIT": _MIT_OPENING + " " + _AS_IS.format(holders="OR COPYRIGHT HOLDERS "),
    "MIT-0": _MIT + ". " + _AS_IS.format(holders="OR COPYRIGHT HOLDERS "),
    "MIT-opening": _MIT_OPENING,
    "MIT-notice": "Released under the MIT License.",
    "ISC": _ISC_OPENING + _ISC_END,
    "ISC-opening": _ISC_OPENING,
    "0BSD": _ISC + "." + _ISC_END,
    "Apache-2.0": _APACHE + " See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-opening": _APACHE,
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "BSD-4-Clause": _BSD + _BSD_4 + _BSD_3 + _BSD_END,
    "BSD-opening": _BSD,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
               "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": _UNLICENSE + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
                 "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
                 "any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
                 "any and all copyright interest in the software to the public domain. We make this dedication for the benefit "
                 "of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
                 "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
                 "law. " + _AS_IS.format(holders="") + " For more information, please refer to <http://unlicense.org/>",
    "Unlicense-opening": _UNLICENSE,
}

#: words of a template that an alignment must match, each at its first place behind the one before
REQUIRED = {
    "MIT": "substantial", "MIT-opening": "substantial", "MIT-notice": "mit", "ISC": "provided that", "ISC-opening": "provided that",
    "Apache-2.0": "apache 2", "Apache-2.0-opening": "apache 2", "Apache-2.0-notice": "apache 2",
    "BSD-3-Clause": "endorse", "BSD-4-Clause": "advertising endorse", "MPL-2.0": "mozilla 2", "Unlicense": "unencumbered", "Unlicense-opening": "unencumbered",
}

#: words that are other members of a family and end a stretch, unless the template has them itself
BARRED: dict[str, str] = {}


def _gnu(name: str, title: str, kind: str, version: str, thing: str, colon: str, end: str) -> None:
    opening = (f"This {thing} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {title} "
               f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
               "later version.")
    TEMPLATES[name] = (
        f"{opening} This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details. You "
        f"should have received a copy of the GNU {title} along with this {thing}{end}")
    TEMPLATES[f"{name}-opening"] = opening
    TEMPLATES[f"{name}-notice"] = f"This work is licensed under the GNU {title}, version {version}."
    for form in (name, f"{name}-opening", f"{name}-notice"):
        REQUIRED[form] = f"{kind} {version}"
        BARRED[form] = "lesser affero"


_LINK = ". If not, see <https://www.gnu.org/licenses/>."
_POST = ("; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
_gnu("GPL-2.0", "General Public License", "general", "2", "program", ";", _POST)
_gnu("GPL-3.0", "General Public License", "general", "3", "program", ":", _LINK)
_gnu("LGPL-2.0", "Library General Public License", "library general", "2", "library", ";", _POST)
_gnu("LGPL-2.1", "Lesser General Public License", "lesser general", "2.1", "library", ";", _POST)
_gnu("LGPL-3.0", "Lesser General Public License", "lesser general", "3", "library", ":", _LINK)
_gnu("AGPL-3.0", "Affero General Public License", "affero general", "3", "program", ":", _LINK)

_LONG = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
_OTHERS = "nc nd sa noncommercial non commercial noderivatives noderivs derivatives derivs sharealike share alike"
for _parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
    for _version, _port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic")):
        _code = "by-nd-nc" if (_parts, _version) == ("by-nc-nd", "1.0") else _parts
        _title = "-".join(_LONG[p] for p in _code.split("-"))
        _title = _title if _version == "4.0" else _title.replace("NoDerivatives", "NoDerivs")
        _name = f"CC-{_parts.upper()}-{_version}"
        _opening = f"This work is licensed under a Creative Commons {_title} {_version} {_port} License."
        _link = f"{_opening} To view a copy of this license, visit http://creativecommons.org/licenses/{_code}/{_version}/"
        TEMPLATES[_name] = f"{_link} or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
        TEMPLATES[f"{_name}-link"] = _link
        TEMPLATES[f"{_name}-opening"] = _opening
        TEMPLATES[f"{_name}-notice"] = f"Licensed under CC {_code.upper()} {_version}."
        for _form in ("", "-link", "-opening", "-notice"):
            REQUIRED[_name + _form] = f"{_code} {_version}" if _form == "-notice" else f"{_title} {_version}"
            BARRED[_name + _form] = _OTHERS
