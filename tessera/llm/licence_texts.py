"""Public licence texts, names and plain sentences from which the licence classifier is trained."""

from __future__ import annotations

#: Opening notices, conditions and headers of published licences, by family. Warranty paragraphs
#: that several families share word by word are left out, as they don't tell which.
TEXTS = {
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    ),
    "bsl": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
}
#: Published names and identifiers, by family; each stands in every frame.
NAMES = {
    "gpl": ("GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL v3", "GPLv3", "GPLv2 license", "GPL-3.0 license", "GPL"),
    "lgpl": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1", "GNU LGPL v3", "LGPLv3", "LGPLv2.1 license", "LGPL-2.1 license", "LGPL"),
    "agpl": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0 license", "AGPL"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license"),
    "mit": ("MIT License", "MIT license", "MIT/X11 license", "Expat License (MIT)"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "new BSD License", "simplified BSD license"),
    "isc": ("ISC License", "ISC license"),
    "zlib": ("zlib License", "zlib/libpng license"),
    "bsl": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0 license"),
    "mpl": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0 license", "MPL"),
    "epl": ("Eclipse Public License 2.0", "Eclipse Public License - v 1.0", "Eclipse Public License, version 2.0", "EPL 2.0", "EPL-2.0 license", "EPL"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0 Public Domain Dedication"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0 license", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0 license", "Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0 license"),
    "cc-by-nd": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0 license"),
}
#: Published identifiers after ``SPDX-License-Identifier:``.
IDENTIFIERS = {
    "gpl": ("GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only"),
    "lgpl": ("LGPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only"),
    "agpl": ("AGPL-3.0-or-later", "AGPL-3.0-only"),
    "apache": ("Apache-2.0",),
    "mit": ("MIT",),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause", "0BSD"),
    "isc": ("ISC",),
    "zlib": ("Zlib",),
    "bsl": ("BSL-1.0",),
    "mpl": ("MPL-2.0", "MPL-1.1"),
    "epl": ("EPL-2.0", "EPL-1.0"),
    "unlicense": ("Unlicense",),
    "cc0": ("CC0-1.0",),
    "cc-by": ("CC-BY-4.0", "CC-BY-3.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"),
    "cc-by-nd": ("CC-BY-ND-4.0",),
}
FRAMES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is distributed under the terms of the {}.",
    "Source code is available under the {}.", "Content is available under {}.",
    "You may use it under the terms of {}.",
)
#: Licences that are no class: their notices teach what an unknown licence looks like.
OTHERS = (
    "Academic Free License v3.0", "Artistic License 2.0", "Common Development and Distribution License", "European Union Public Licence 1.2", "Microsoft Public License", "Open Software License 3.0",
    "Python Software Foundation License", "PostgreSQL License", "SIL Open Font License 1.1", "Q Public License", "Server Side Public License", "Elastic License 2.0", "Business Source License 1.1", "OpenSSL License",
    "Ruby License", "PHP License 3.01", "Vim License", "Zope Public License 2.1", "Do What The F*ck You Want To Public License", "GNU Free Documentation License",
)
OTHER_NOTICES = (
    "All rights reserved.", "Copyright (c) 2019 by the authors. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    "No part of this publication may be reproduced without the prior written permission of the publisher.", "See the LICENSE file for details.", "Please read the license agreement before you use the software.",
    "The software is licensed, not sold. You may use one copy of the software on one computer.", "This image is copyright of the museum and must not be used for commercial purposes.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
)
#: Sentences that use the same words without naming a licence.
ORDINARY = (
    "The driver must carry a valid license when he is on the road.", "The work was released in version 2 of the report last week.",
    "He had a license to fish in the river under the bridge.", "The public is free to use the path in the park.",
    "A copy of the software was sold under another name.", "The general said that the source of the river is in the north.",
    "She was granted permission to leave the building at noon.", "The committee may modify the terms of use at any time.",
    "This program is shown on television every week.", "The foundation was published by a person who likes music.",
    "The state licensed two new power plants in 2019.", "It is not in compliance with the rules of the game.",
    "The creative work of the commons committee was released.", "Version 3 of the plan has more conditions.",
    "He worked at MIT for ten years.", "The Apache helicopter landed near the base.", "The binary forms of the code are in the source.",
    "The eclipse was seen by the public in the whole of the north.", "A boost to software sales is expected in the public sector.",
    "The lesser known general won the public over without restriction.", "Attribution of the painting to the artist is not certain.",
    "The domain is open to the public on Sundays and commercial use of the lawn is not permitted.", "Members are granted free entry, subject to the following conditions of the club.",
    "The redistribution of land was the main point of the public debate.", "The origin of the word is not known and the warranty has run out.",
)
