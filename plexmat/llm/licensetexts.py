"""Sentences of public licence texts and notices by identifier, and the ordered rules over them."""

SENTENCES: dict[str, str] = {
    # MIT, X11
    "mit_title": "MIT License",
    "mit_notice": "under the MIT License",
    "mit_notice_terms": "under the terms of the MIT License",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit_0_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "x11_endorse": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",
    # ISC, 0BSD
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_notice": "under the ISC License",
    "bsd0_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc_warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    # BSD
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_endorse_organization": "Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_endorse_author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_2_notice": "under the BSD 2-Clause License",
    "bsd_3_notice": "under the BSD 3-Clause License",
    # Apache
    "apache_notice": "Licensed under the Apache License, Version 2.0",
    "apache_notice_under": "under the Apache License 2.0",
    "apache_notice_version": "under the Apache License, Version 2.0",
    "apache_notice_terms": "under the terms of the Apache License, Version 2.0",
    "apache_you_may_not": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "as_is_law": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache_limits": "See the License for the specific language governing permissions and limitations under the License",
    "apache_terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache_grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    # GNU
    "gpl2_only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2",
    "gpl2_later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3_only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl3_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_notice": "licensed under the GNU General Public License, version 2",
    "gpl3_notice": "licensed under the GNU General Public License, version 3",
    "gpl2_title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3_title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21_title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3_title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3_title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu_verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gpl_no_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl_no_warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    # Mozilla, Eclipse, CDDL
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl2_title": "Mozilla Public License Version 2.0",
    "epl2_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl1_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl2_title": "Eclipse Public License - v 2.0",
    "cddl_notice": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    # zlib, Boost, Unlicense, WTFPL, PostgreSQL, NCSA, OFL, Artistic
    "zlib_warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib_origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib_notice": "This notice may not be removed or altered from any source distribution",
    "bsl_title": "Boost Software License - Version 1.0",
    "bsl_notice": "Distributed under the Boost Software License, Version 1.0",
    "bsl_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense_grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl_title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "postgresql_grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ncsa_title": "University of Illinois/NCSA Open Source License",
    "ncsa_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction',
    "ofl_notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "artistic2_title": "The Artistic License 2.0",
    # Creative Commons
    "cc0_notice": "CC0 1.0 Universal",
    "cc0_waive": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc_by_notice": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc_by_short": "Licensed under CC BY 4.0",
    "cc_by_sa_notice": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc_by_sa_short": "Licensed under CC BY-SA 4.0",
    "cc_by_nc_notice": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc_by_nc_short": "Licensed under CC BY-NC 4.0",
    "cc_by_nd_notice": "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc_by_nd_short": "Licensed under CC BY-ND 4.0",
    "cc_by_nc_sa_notice": "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc_by_nc_sa_short": "Licensed under CC BY-NC-SA 4.0",
    "cc_by_nc_nd_notice": "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "cc_by_nc_nd_short": "Licensed under CC BY-NC-ND 4.0",
}

#: (licence, identifiers in order, identifiers that rule it out); any rule of a licence is enough.
RULES: list[tuple[str, list[str], list[str]]] = [
    ("0BSD", ["bsd0_grant", "isc_warranty"], []),
    ("AGPL-3.0-only", ["agpl3_title", "gnu_verbatim"], []),
    ("AGPL-3.0-or-later", ["agpl3_later", "gpl_no_warranty"], []),
    ("Apache-2.0", ["apache_notice"], []),
    ("Apache-2.0", ["apache_notice_under"], []),
    ("Apache-2.0", ["apache_notice_version"], []),
    ("Apache-2.0", ["apache_notice_terms"], []),
    ("Apache-2.0", ["apache_you_may_not", "apache_copy", "as_is_law"], []),
    ("Apache-2.0", ["apache_terms", "apache_grant"], []),
    ("Artistic-2.0", ["artistic2_title"], []),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"], ["bsd_endorse", "bsd_endorse_organization", "bsd_endorse_author", "bsd_advertise"]),
    ("BSD-2-Clause", ["bsd_2_notice"], []),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"], ["bsd_advertise"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse_organization"], ["bsd_advertise"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse_author"], ["bsd_advertise"]),
    ("BSD-3-Clause", ["bsd_3_notice"], []),
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advertise"], []),
    ("BSL-1.0", ["bsl_title", "bsl_grant"], []),
    ("BSL-1.0", ["bsl_notice"], []),
    ("CC-BY-4.0", ["cc_by_notice"], []),
    ("CC-BY-4.0", ["cc_by_short"], []),
    ("CC-BY-NC-4.0", ["cc_by_nc_notice"], []),
    ("CC-BY-NC-4.0", ["cc_by_nc_short"], []),
    ("CC-BY-NC-ND-4.0", ["cc_by_nc_nd_notice"], []),
    ("CC-BY-NC-ND-4.0", ["cc_by_nc_nd_short"], []),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa_notice"], []),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa_short"], []),
    ("CC-BY-ND-4.0", ["cc_by_nd_notice"], []),
    ("CC-BY-ND-4.0", ["cc_by_nd_short"], []),
    ("CC-BY-SA-4.0", ["cc_by_sa_notice"], []),
    ("CC-BY-SA-4.0", ["cc_by_sa_short"], []),
    ("CC0-1.0", ["cc0_notice"], []),
    ("CC0-1.0", ["cc0_waive"], []),
    ("CDDL-1.0", ["cddl_notice"], []),
    ("EPL-1.0", ["epl1_notice"], []),
    ("EPL-2.0", ["epl2_notice"], []),
    ("EPL-2.0", ["epl2_title"], []),
    ("GPL-2.0", ["gpl2_notice"], []),
    ("GPL-2.0-only", ["gpl2_only", "gpl_no_warranty"], []),
    ("GPL-2.0-only", ["gpl2_title", "gnu_verbatim"], []),
    ("GPL-2.0-or-later", ["gpl2_later", "gpl_no_warranty"], []),
    ("GPL-3.0", ["gpl3_notice"], []),
    ("GPL-3.0-only", ["gpl3_only", "gpl_no_warranty"], []),
    ("GPL-3.0-only", ["gpl3_title", "gnu_verbatim"], []),
    ("GPL-3.0-or-later", ["gpl3_later", "gpl_no_warranty"], []),
    ("ISC", ["isc_grant"], []),
    ("ISC", ["isc_grant_and", "isc_warranty"], []),
    ("ISC", ["isc_notice"], []),
    ("LGPL-2.1-only", ["lgpl21_title", "gnu_verbatim"], []),
    ("LGPL-2.1-or-later", ["lgpl21_later", "lgpl_no_warranty"], []),
    ("LGPL-3.0-only", ["lgpl3_title", "gnu_verbatim"], []),
    ("LGPL-3.0-or-later", ["lgpl3_later"], []),
    ("MIT", ["mit_notice"], []),
    ("MIT", ["mit_notice_terms"], []),
    ("MIT", ["mit_grant", "mit_condition"], ["x11_endorse"]),
    ("MIT", ["mit_title", "mit_grant"], ["x11_endorse"]),
    ("MIT-0", ["mit_0_grant", "mit_warranty"], []),
    ("MPL-2.0", ["mpl2_notice", "mpl2_copy"], []),
    ("MPL-2.0", ["mpl2_notice"], []),
    ("MPL-2.0", ["mpl2_title"], []),
    ("NCSA", ["ncsa_title", "ncsa_grant"], []),
    ("OFL-1.1", ["ofl_notice"], []),
    ("PostgreSQL", ["postgresql_grant"], []),
    ("Unlicense", ["unlicense"], []),
    ("Unlicense", ["unlicense_grant"], []),
    ("WTFPL", ["wtfpl_title"], []),
    ("X11", ["mit_grant", "mit_condition", "x11_endorse"], []),
    ("Zlib", ["zlib_warranty", "zlib_grant"], []),
    ("Zlib", ["zlib_grant", "zlib_origin", "zlib_notice"], []),
]
