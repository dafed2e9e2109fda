"""Wording of licence notices: what the classifier learns from, what it is measured on, and what is no notice."""

from __future__ import annotations

# Customary notices of each licence family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
        "Dual licensed under Apache-2.0 or MIT",
    ],
    "mit": [
        "Released under the MIT License",
        "This software is licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
        "Dual licensed under MIT or GPL",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
        "ISC License Copyright",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL v2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the LGPL",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the AGPL v3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under CC BY-SA 3.0",
        "Licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
# For each family, words of which one stands in each of its notices, or near it; full texts without a name have none.
NAMES = {
    "apache": {"apache"}, "mit": {"mit", "permission", "substantial"}, "isc": {"isc", "permission"}, "gpl": {"gpl", "gplv2", "gplv3", "general"}, "lgpl": {"lgpl", "lesser"}, "agpl": {"agpl", "affero"},
    "bsd": {"bsd", "redistribution"}, "mpl": {"mozilla", "mpl"}, "epl": {"eclipse", "epl"}, "cc-by": {"attribution", "by"}, "cc-by-sa": {"sharealike", "sa"},
    "cc-by-nc": {"noncommercial", "nc"}, "public-domain": {"public", "cc0", "waived", "unlicense"},
}
# How short notices begin, and the names that families go by in them.
OPENINGS = [
    "Licensed under", "Released under", "Distributed under", "Distributed under the terms of", "This work is licensed under", "This software is licensed under", "This project is released under",
    "is made available under", "Made available under the terms of", "is free software, released under", "Text is available under", "is provided under", "is licensed under", "is distributed under",
    "License:", "Licence:", "Published under", "The code is under", "is subject to", "may be used under", "You may use it under the terms of", "Rights are granted under", "available under", "comes under",
]
NAMED = {
    "apache": ["the Apache License, Version 2.0", "the Apache 2.0 license", "Apache-2.0", "the Apache License 2.0"],
    "mit": ["the MIT License", "MIT", "the MIT licence"],
    "isc": ["the ISC License", "ISC"],
    "gpl": ["the GNU General Public License, version 3", "the GPL v2 or later", "the GNU GPL", "GPLv3", "the GNU General Public License version 2", "GPL 3.0"],
    "lgpl": ["the GNU Lesser General Public License, version 2.1", "the LGPL", "LGPL version 3", "the GNU Lesser General Public License"],
    "agpl": ["the GNU Affero General Public License, version 3", "the AGPL v3", "AGPL-3.0", "the GNU Affero General Public License"],
    "bsd": ["the BSD 3-Clause License", "the BSD license", "the 2-clause BSD license", "a BSD-style license"],
    "mpl": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "the Mozilla Public License, version 2.0"],
    "epl": ["the Eclipse Public License 2.0", "the EPL", "EPL 1.0", "the Eclipse Public License, version 1.0"],
    "cc-by": ["a Creative Commons Attribution 4.0 International License", "CC BY 4.0", "the Creative Commons Attribution License", "CC BY 3.0"],
    "cc-by-sa": ["a Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0"],
    "cc-by-nc": ["a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial License", "CC BY-NC 3.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0", "the Unlicense"],
}
# Other openings, which nothing is trained on: the first ones for the temperature, the others to measure on.
HELD_OUT_OPENINGS = [
    "This package is available as open source under the terms of", "This file is offered under", "This module is covered by", "Shared under", "Its use is governed by", "Unless stated otherwise, all files here fall under",
]
# Openings of notices whose family is not listed, and sentences about licences that are no notices.
OTHER_NOTICES = ["Licensed under the {} License", "Released under the {} license, version 1.0", "This work is licensed under the {} Public License", "Distributed under the terms of the {} licence"]
NO_NOTICES = [
    "The driver must carry a license", "He lost his fishing license last year", "a licensed professional should install it", "The committee discussed the cost of the license",
    "Free admission is granted to any person under the age of ten", "The general public was invited to the permission hearing", "the terms of the agreement were discussed in version two of the report",
    "copy of the file was obtained", "an international work of creative people in the commons", "MIT is a university", "apache helicopters", "redistribution of land in binary stars",
    "The MIT license debate continued", "critics of the GPL say that it is viral", "Mozilla and Apache are foundations", "a talk about open source licenses such as MIT, BSD and Apache",
    "the history of the GNU General Public License", "a total eclipse was seen in public", "Creative Commons was founded in 2001", "books in the public domain are read by many",
]
# Sentences to measure false positives on, which nothing is trained on.
HELD_OUT_NO_NOTICES = [
    "The MIT license debate went on in the house for a week", "An article compares the Apache license with the GPL", "She holds a pilot license and a public office", "Students of MIT wrote the general report",
    "the software was distributed to the public free of charge in 1999", "lawyers disagree about the Mozilla Public License", "The commons were open to creative work of every kind", "the permission was granted to the person who asked",
]


def composed(openings: list[str]) -> dict[str, list[str]]:
    """Short notices of each family by some openings."""
    return {family: [f"{opening} {name}" for opening in openings for name in names] for family, names in NAMED.items()}
