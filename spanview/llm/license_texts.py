"""Licence wordings: public texts as their authors publish them, without names and years."""

from __future__ import annotations

#: (words, label) whose places count as base.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: (label, mandatory key phrases, wording). Every key phrase is part of the wording.
TEMPLATES = (
    ("mit", ["hereby granted free of charge"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", ["mit license"], "released under the MIT License"),
    (
        "mit",
        ["hereby granted free of charge", "without limitation the rights to use copy modify merge publish distribute sublicense"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"
        " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("mit", ["copies or substantial portions of the software"], "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (
        "mit",
        ["out of or in connection with the software or the use or other dealings in the software"],
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness"
        " for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether"
        " in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    ("apache-2", ["apache license version 2"], "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        ["apache license version 2", "except in compliance with the license"],
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache-2",
        ["specific language governing permissions and limitations under the license"],
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES"
        " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd", ["source and binary forms"], "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", ["bsd license"], "licensed under the BSD License"),
    ("bsd", ["redistributions of source code must retain"], "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (
        "bsd",
        ["redistributions in binary form must reproduce"],
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
        " other materials provided with the distribution.",
    ),
    ("bsd-3-clause", ["endorse or promote products derived from this software"], "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", ["gnu general public license"], "GNU General Public License"),
    (
        "gpl",
        ["gnu general public license as published by the free software foundation"],
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl",
        ["see the gnu general public license for more details"],
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR"
        " A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("lgpl", ["gnu lesser general public license"], "GNU Lesser General Public License"),
    (
        "lgpl",
        ["gnu lesser general public license as published by the free software foundation"],
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free"
        " Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("agpl", ["gnu affero general public license"], "GNU Affero General Public License"),
    (
        "agpl",
        ["gnu affero general public license as published by the free software foundation"],
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free"
        " Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("mpl", ["mozilla public license"], "Mozilla Public License"),
    (
        "mpl",
        ["subject to the terms of the mozilla public license"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("epl", ["eclipse public license"], "Eclipse Public License"),
    ("epl", ["terms of the eclipse public license"], "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("isc", ["distribute this software for any purpose"], "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    (
        "isc",
        ["distribute this software for any purpose with or without fee"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright"
        " notice and this permission notice appear in all copies.",
    ),
    ("unlicense", ["free and unencumbered software"], "This is free and unencumbered software released into the public domain"),
    (
        "unlicense",
        ["either in source code form or as a compiled binary"],
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        ["held liable for any damages arising from the use of this software"],
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
    (
        "zlib",
        ["alter it and redistribute it freely"],
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to"
        " the following restrictions:",
    ),
    (
        "bsl-1",
        ["use reproduce display distribute execute and transmit the software"],
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this"
        " license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    ("cc0", ["waived all copyright and related or neighboring rights"], "has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", ["cc by sa"], "CC BY-SA"),
    ("cc-by-sa", ["creative commons attribution sharealike"], "Creative Commons Attribution-ShareAlike"),
    ("cc-by-nd", ["cc by nd"], "CC BY-ND"),
    ("cc-by-nc", ["creative commons attribution noncommercial"], "Creative Commons Attribution-NonCommercial"),
    ("cc-by", ["creative commons attribution"], "Creative Commons Attribution"),
    ("all-rights-reserved", ["all rights reserved"], "All rights reserved"),
)
