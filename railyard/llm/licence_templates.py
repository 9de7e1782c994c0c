"""Licence templates: sentences that grant a licence, standard headers, whole texts, and SPDX identifiers."""

from __future__ import annotations

from pathlib import Path

# sentences, titles and names on a line of their own; {v} is a version -------
_SENTENCES = [
    ("Apache-{v}", ["1.0", "1.1", "2.0"], ["Licensed under the Apache License, Version {v}", "Apache License, Version {v}", "Apache License {v}"]),
    ("MPL-{v}", ["1.0", "1.1", "2.0"], ["Subject to the terms of the Mozilla Public License, version {v}", "Licensed under the Mozilla Public License, version {v}",
                                        "Mozilla Public License Version {v}"]),
    ("GPL-{v}.0", ["1", "2", "3"], ["This work is licensed under the GNU General Public License, version {v}", "GNU General Public License version {v}", "GNU GPL v{v}"]),
    ("GPL-{v}.0-or-later", ["1", "2", "3"], ["Licensed under the GNU General Public License, version {v} or any later version"]),
    ("LGPL-{v}", ["2.0", "2.1", "3.0"], ["This work is licensed under the GNU Lesser General Public License, version {v}", "GNU Lesser General Public License version {v}"]),
    ("LGPL-{v}", ["3.0"], ["This work is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3"]),
    ("LGPL-{v}", ["2.0"], ["GNU Library General Public License version 2"]),
    ("AGPL-{v}.0", ["3"], ["This work is licensed under the GNU Affero General Public License, version {v}", "GNU Affero General Public License version {v}"]),
    ("EPL-{v}", ["1.0", "2.0"], ["Licensed under the Eclipse Public License, version {v}", "Eclipse Public License {v}"]),
    *((f"CC-{n}-{{v}}", ["1.0", "2.0", "2.5", "3.0", "4.0"], [f"Licensed under CC {n} {{v}}", f"Creative Commons {long} {{v}} International License"])
      for n, long in (("BY", "Attribution"), ("BY-SA", "Attribution ShareAlike"), ("BY-ND", "Attribution NoDerivatives"), ("BY-NC", "Attribution NonCommercial"),
                      ("BY-NC-SA", "Attribution NonCommercial ShareAlike"), ("BY-NC-ND", "Attribution NonCommercial NoDerivatives"))),
    ("CC0-{v}", ["1.0"], ["Dedicated to the public domain under CC0 {v}", "CC0 {v} Universal"]),
    ("MIT", [""], ["Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)", "MIT License"]),
    ("BSD-2-Clause", [""], ["Redistributed under the terms of the two clause BSD License", "BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", [""], ["Redistributed under the terms of the three clause BSD License", "BSD 3-Clause License", "New BSD License",
                            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                            "derived from this software without specific prior written permission."]),
    ("ISC", [""], ["Released under the ISC License", "ISC License"]),
    ("Unlicense", [""], ["This is free and unencumbered software released into the public domain."]),
]

# short texts and the paragraphs by which source files grant a licence -------
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_REST = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
"""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
_GNU_LATER = "either version {v} of the License, or (at your option) any later version."
_BLOCKS = [
    ("MIT", f"{_MIT}, subject to the following conditions:"), ("MIT", f"MIT License\n{_MIT}, subject to the following conditions:\n{_NOTICE}\n{_MIT_REST}"),
    ("MIT-0", f"{_MIT}."), ("MIT-0", f"{_MIT}.\n{_MIT_REST}"),
    ("BSD-2-Clause", _BSD + _BSD_REST), ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_REST),
    ("ISC", _ISC + _ISC_NOTICE), ("0BSD", _ISC + "."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
                   "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                "https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
                  "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *((f"{short}-{v if '.' in v else v + '.0'}{tail}", _GNU.format(name=name) + words.format(v=v))
      for short, name, versions in (("GPL", "General Public License", "123"), ("LGPL", "Lesser General Public License", ["2.1", "3"]),
                                    ("LGPL", "Library General Public License", ["2"]), ("AGPL", "Affero General Public License", "3"))
      for v in versions for tail, words in (("-or-later", _GNU_LATER), ("-only", "version {v} of the License."))),
]

# whole texts kept beside this module ----------------------------------------
_FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1",
          "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
# ---------------------------------------------------------------------------


def templates() -> list[tuple[str, str]]:
    """``(licence, text)`` of every template."""
    folder = Path(__file__).with_name("licence_texts")
    lines = [(name.format(v=v), s.format(v=v)) for name, versions, sentences in _SENTENCES for v in versions for s in sentences]
    return lines + _BLOCKS + [(name, (folder / f"{f}.txt").read_text()) for name, f in _FILES.items()]


def spdx_ids() -> dict[str, str]:
    """Licence by lower-case identifier of an SPDX tag: all licences above, and the ``-only``, ``-or-later`` and ``+`` forms of the GNU ones."""
    names = {name for name, _ in templates()}
    names |= {n + tail for n in names if "GPL" in n and n[-1] == "0" or n == "LGPL-2.1" for tail in ("-only", "-or-later")}
    plus = {f"{n.removesuffix('-or-later')}+".lower(): n for n in names if n.endswith("-or-later")}
    return {n.lower(): n for n in names} | plus
