"""Notices and short bodies of public licences, and phrases of which one must occur for a licence to be proven."""

from __future__ import annotations

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means."""

APACHE_2 = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
the License for the specific language governing permissions and limitations under the License."""

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for
more details."""

MPL_2 = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

CC0 = """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to
this work."""

_PUBLISHED = "as published by the free software foundation either version"

#: label -> (templates, mandatory key phrases of which one must occur)
TEMPLATES = {
    "agpl": (["licensed under the gnu affero general public license version 3", _GNU.format(name="Affero General Public License", version=3)], ["affero general public license"]),
    "apache-2.0": (["licensed under the apache license version 2 0", "licensed under the apache license 2 0", APACHE_2], ["apache license version 2 0", "apache license 2 0"]),
    "bsd": (["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", BSD], ["redistribution and use in source and binary forms", "bsd license"]),
    "cc-by-nc": (["licensed under cc by nc 4 0", "creative commons attribution noncommercial license"], ["cc by nc", "creative commons attribution noncommercial"]),
    "cc-by-sa": (["licensed under cc by sa 4 0", "creative commons attribution sharealike license"], ["cc by sa", "creative commons attribution sharealike"]),
    "cc0": (["creative commons zero universal public domain dedication", CC0], ["creative commons zero", "waived all copyright and related or neighboring rights"]),
    "gpl-2.0": (["licensed under the gnu general public license version 2", _GNU.format(name="General Public License", version=2)], ["gnu general public license version 2", f"gnu general public license {_PUBLISHED} 2"]),
    "gpl-3.0": (["licensed under the gnu general public license version 3", _GNU.format(name="General Public License", version=3)], ["gnu general public license version 3", f"gnu general public license {_PUBLISHED} 3"]),
    "isc": (["released under the isc license", ISC], ["isc license", "for any purpose with or without fee is hereby granted"]),
    "lgpl": (["licensed under the gnu lesser general public license version 3", _GNU.format(name="Lesser General Public License", version=3)], ["lesser general public license"]),
    "mit": (["released under the mit license", MIT], ["mit license", "permission is hereby granted free of charge"]),
    "mpl": (["subject to the terms of the mozilla public license version 2 0", MPL_2], ["mozilla public license"]),
    "unlicense": (["released under the unlicense", UNLICENSE], ["released under the unlicense", "free and unencumbered software"]),
    "zlib": (["released under the zlib license", ZLIB], ["zlib license", "altered source versions must be plainly marked"]),
}
