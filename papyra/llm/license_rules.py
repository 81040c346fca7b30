"""Signature rules for licences: ``identifier | priority | keywords | pattern``, a rule a line, in order.

All keywords (lower case, comma-separated; of some joined by a slash, one) must be in a text for the pattern to be tried. In a pattern a space matches any
white space and comment marks at line starts. Patterns ignore case, except where they say ``(?-i:...)``. Priority 90: the
body of a licence; 80: a machine-readable tag; 70: a notice with name and version; 50: a name; 30: a hint.
"""

RULES = r"""
Apache-2.0|90|apache,conditions|Apache License,? Version 2\.0,? January 2004 (?:https?://www\.apache\.org/licenses/? )?TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
Apache-2.0|90|apache,compliance|Licensed under the Apache License,? Version 2\.0 \(the "?License"?\);? you may not use this file except in compliance with the License
Apache-2.0|80|spdx,apache|SPDX-License-Identifier: ?\(?Apache-2\.0\b
Apache-2.0|70|apache|(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?Apache(?: Software)? Licen[sc]e,?(?: \(?Version| v\.?)? ?2(?:\.0)?\b\)?
Apache-2.0|70|apache|Apache(?: Software)? Licen[sc]e,? Version 2(?:\.0)?\b
Apache-2.0|50|apache|Apache(?: Software)?(?: Licen[sc]e)?[ -](?:v(?:ersion)?\.? ?)?2\.0\b
Apache-2.0|50|apache.org|https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?
Apache-2.0|50|opensource.org,apache|https?://(?:www\.)?opensource\.org/licenses?/apache-2\.0
Apache-1.1|90|apache,documentation|Apache Software License,? Version 1\.1\b.{0,400}?end-user documentation
Apache-1.1|80|spdx,apache|SPDX-License-Identifier: ?\(?Apache-1\.1\b
Apache-1.1|70|apache|Apache(?: Software)? Licen[sc]e,? (?:Version|v\.?) ?1\.1\b
Apache-1.0|80|spdx,apache|SPDX-License-Identifier: ?\(?Apache-1\.0\b
Apache-1.0|70|apache|Apache(?: Software)? Licen[sc]e,? (?:Version|v\.?) ?1\.0\b
Apache|30|apache|(?:under|by) (?:the )?(?:terms of )?(?:the )?Apache(?: Software)? Licen[sc]e\b
MIT|90|permission,charge|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.{0,1200}?THE SOFTWARE IS PROVIDED "?AS IS"?
MIT|70|permission,charge|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT|80|spdx,mit|SPDX-License-Identifier: ?\(?(?-i:MIT)(?![\w-])
MIT|70|mit|(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?-i:MIT)(?: (?:Software )?Licen[sc]e)?\b
MIT|50|mit|(?:the )?(?-i:MIT)(?:/Expat| \(Expat\))? Licen[sc]e\b
MIT|50|opensource.org,mit|https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?\b
MIT|50|expat|Expat Licen[sc]e\b
MIT-0|90|permission,charge|MIT No Attribution.{0,300}?Permission is hereby granted, free of charge
MIT-0|80|spdx,mit|SPDX-License-Identifier: ?\(?MIT-0\b
MIT-0|50|attribution|MIT No Attribution(?: Licen[sc]e)?\b
X11|80|spdx,x11|SPDX-License-Identifier: ?\(?X11\b
X11|50|x11|(?:MIT/)?X11 Licen[sc]e\b
X11|90|consortium,permission|Copyright \(C\) \d{4} X Consortium.{0,200}?Permission is hereby granted
GPL-3.0-or-later|90|gnu,later|GNU General Public License as published by the Free Software Foundation,? either version 3 of the License,? or \(at your option\) any later version
GPL-3.0-only|90|gnu,june|GNU GENERAL PUBLIC LICENSE,? Version 3,? 29 June 2007\b
GPL-3.0-or-later|80|spdx,gpl|SPDX-License-Identifier: ?\(?GPL-3\.0(?:-or-later|\+)
GPL-3.0-only|80|spdx,gpl|SPDX-License-Identifier: ?\(?GPL-3\.0(?:-only)?(?![\w+-])
GPL-3.0-or-later|70|gnu,later/newer/above|GNU General Public Licen[sc]e,? (?:version |v\.? ?)?3(?:\.0)? or (?:\(at your option\) )?(?:any )?(?:later|newer|above)\b
GPL-3.0-only|70|gnu|(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?GNU General Public Licen[sc]e,? \(?(?:version |v\.? ?)3(?:\.0)?\b\)?
GPL-3.0-only|70|gnu|GNU General Public Licen[sc]e,? \(?(?:version |v\.? ?)3(?:\.0)?\b\)?
GPL-3.0-only|50|gpl|\b(?:GNU )?(?-i:GPL)[ -]?(?:version |v\.? ?)?3(?:\.0)?(?![\d.]\d|\+|[\w])
GPL-3.0-or-later|50|gpl|\b(?:GNU )?(?-i:GPL)[ -]?(?:version |v\.? ?)?3(?:\.0)?(?:\+| or (?:any )?later\b)
GPL-3.0-only|50|gnu.org,gpl|https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.en)?(?:\.html|\.txt)?
GPL-2.0-or-later|90|gnu,later|GNU General Public License as published by the Free Software Foundation;? either version 2 of the License,? or \(at your option\) any later version
GPL-2.0-only|90|gnu,june|GNU GENERAL PUBLIC LICENSE,? Version 2,? June 1991\b
GPL-2.0-only|90|gnu,published|GNU General Public License,? version 2,? as published by the Free Software Foundation\b
GPL-2.0-or-later|80|spdx,gpl|SPDX-License-Identifier: ?\(?GPL-2\.0(?:-or-later|\+)
GPL-2.0-only|80|spdx,gpl|SPDX-License-Identifier: ?\(?GPL-2\.0(?:-only)?(?![\w+-])
GPL-2.0-or-later|70|gnu,later/newer/above|GNU General Public Licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)? or (?:\(at your option\) )?(?:any )?(?:later|newer|above)\b
GPL-2.0-only|70|gnu|GNU General Public Licen[sc]e,? \(?(?:version |v\.? ?)2(?:\.0)?\b\)?
GPL-2.0-only|50|gpl|\b(?:GNU )?(?-i:GPL)[ -]?(?:version |v\.? ?)?2(?:\.0)?(?![\d.]\d|\+|[\w])
GPL-2.0-or-later|50|gpl|\b(?:GNU )?(?-i:GPL)[ -]?(?:version |v\.? ?)?2(?:\.0)?(?:\+| or (?:any )?later\b)
GPL-2.0-only|50|gnu.org,gpl|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.en)?(?:\.html|\.txt)?
GPL-2.0-with-classpath-exception|80|spdx,classpath|SPDX-License-Identifier: ?\(?GPL-2\.0(?:-only|-or-later)? WITH Classpath-exception-2\.0
GPL-2.0-with-classpath-exception|70|classpath|GNU General Public Licen[sc]e.{0,120}?with (?:the )?(?:GNU )?"?Classpath"? exception
GPL-1.0-or-later|80|spdx,gpl|SPDX-License-Identifier: ?\(?GPL-1\.0(?:-or-later|\+)
GPL-1.0-only|90|gnu,february|GNU GENERAL PUBLIC LICENSE,? Version 1,? February 1989\b
GPL-1.0-or-later|50|general|(?:GNU )?General Public Licen[sc]e\b
GPL-1.0-or-later|30|gnu,gpl|\bGNU (?-i:GPL)\b
GPL-1.0-or-later|30|gpl|(?:licen[sc]ed|released|distributed|available) under (?:the )?(?-i:GPL)\b
LGPL-3.0-or-later|90|gnu,lesser,later|GNU Lesser General Public License as published by the Free Software Foundation,? either version 3(?:\.0)? of the License,? or \(at your option\) any later version
LGPL-3.0-only|90|gnu,lesser|GNU LESSER GENERAL PUBLIC LICENSE,? Version 3,? 29 June 2007\b
LGPL-3.0-or-later|80|spdx,lgpl|SPDX-License-Identifier: ?\(?LGPL-3\.0(?:-or-later|\+)
LGPL-3.0-only|80|spdx,lgpl|SPDX-License-Identifier: ?\(?LGPL-3\.0(?:-only)?(?![\w+-])
LGPL-3.0-only|70|lesser|(?:GNU )?Lesser General Public Licen[sc]e,? \(?(?:version |v\.? ?)3(?:\.0)?\b\)?
LGPL-3.0-only|50|lgpl|\b(?:GNU )?(?-i:LGPL)[ -]?(?:version |v\.? ?)?3(?:\.0)?(?![\d.]\d|\+|[\w])
LGPL-3.0-or-later|50|lgpl|\b(?:GNU )?(?-i:LGPL)[ -]?(?:version |v\.? ?)?3(?:\.0)?(?:\+| or (?:any )?later\b)
LGPL-2.1-or-later|90|lesser,later|GNU Lesser General Public License as published by the Free Software Foundation;? either version 2\.1 of the License,? or \(at your option\) any later version
LGPL-2.1-only|90|gnu,lesser|GNU LESSER GENERAL PUBLIC LICENSE,? Version 2\.1,? February 1999\b
LGPL-2.1-or-later|80|spdx,lgpl|SPDX-License-Identifier: ?\(?LGPL-2\.1(?:-or-later|\+)
LGPL-2.1-only|80|spdx,lgpl|SPDX-License-Identifier: ?\(?LGPL-2\.1(?:-only)?(?![\w+-])
LGPL-2.1-only|70|lesser|(?:GNU )?Lesser General Public Licen[sc]e,? \(?(?:version |v\.? ?)2\.1\b\)?
LGPL-2.1-only|50|lgpl|\b(?:GNU )?(?-i:LGPL)[ -]?(?:version |v\.? ?)?2\.1(?![\d.]\d|\+|[\w])
LGPL-2.1-or-later|50|lgpl|\b(?:GNU )?(?-i:LGPL)[ -]?(?:version |v\.? ?)?2\.1(?:\+| or (?:any )?later\b)
LGPL-2.0-only|80|spdx,lgpl|SPDX-License-Identifier: ?\(?LGPL-2\.0(?:-only)?(?![\w+-])
LGPL-2.0-or-later|80|spdx,lgpl|SPDX-License-Identifier: ?\(?LGPL-2\.0(?:-or-later|\+)
LGPL-2.0-only|90|gnu,library|GNU LIBRARY GENERAL PUBLIC LICENSE,? Version 2,? June 1991\b
LGPL-2.0-or-later|70|library,later|GNU Library General Public License as published by the Free Software Foundation;? either version 2 of the License,? or \(at your option\) any later version
LGPL-2.0-only|50|library,general|(?:GNU )?Library General Public Licen[sc]e\b
LGPL-2.1-or-later|30|lesser,general|(?:GNU )?Lesser General Public Licen[sc]e\b
LGPL-2.1-or-later|30|lgpl|(?:under|by) (?:the )?(?:GNU )?(?-i:LGPL)\b
AGPL-3.0-or-later|90|affero,later|GNU Affero General Public License as published by the Free Software Foundation,? either version 3 of the License,? or \(at your option\) any later version
AGPL-3.0-only|90|gnu,affero|GNU AFFERO GENERAL PUBLIC LICENSE,? Version 3,? 19 November 2007\b
AGPL-3.0-or-later|80|spdx,agpl|SPDX-License-Identifier: ?\(?AGPL-3\.0(?:-or-later|\+)
AGPL-3.0-only|80|spdx,agpl|SPDX-License-Identifier: ?\(?AGPL-3\.0(?:-only)?(?![\w+-])
AGPL-3.0-only|70|affero|(?:GNU )?Affero General Public Licen[sc]e,? \(?(?:version |v\.? ?)3(?:\.0)?\b\)?
AGPL-3.0-only|50|agpl|\b(?:GNU )?(?-i:AGPL)[ -]?(?:version |v\.? ?)?3(?:\.0)?(?![\d.]\d|\+|[\w])
AGPL-3.0-or-later|30|affero|(?:GNU )?Affero General Public Licen[sc]e\b
AGPL-1.0-only|70|affero|Affero General Public Licen[sc]e,? (?:version |v\.? ?)1(?:\.0)?\b
GFDL-1.3-or-later|90|documentation,later|GNU Free Documentation License,? Version 1\.3 or any later version published by the Free Software Foundation
GFDL-1.3-only|80|spdx,gfdl|SPDX-License-Identifier: ?\(?GFDL-1\.3(?:-only|-or-later)?\b
GFDL-1.2-or-later|90|documentation,later|GNU Free Documentation License,? Version 1\.2 or any later version published by the Free Software Foundation
GFDL-1.2-only|80|spdx,gfdl|SPDX-License-Identifier: ?\(?GFDL-1\.2(?:-only|-or-later)?\b
GFDL-1.1-only|80|spdx,gfdl|SPDX-License-Identifier: ?\(?GFDL-1\.1(?:-only|-or-later)?\b
GFDL-1.3-or-later|50|gnu,documentation|GNU Free Documentation Licen[sc]e\b
GFDL-1.3-or-later|30|gfdl|\b(?-i:GFDL)\b
BSD-3-Clause|90|redistribution,endorse|Redistribution and use in source and binary forms,? with or without modification,? are permitted provided that.{0,900}?Neither the names? of .{1,200}?endorse or promote products
BSD-2-Clause|70|redistribution,binary|Redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met
BSD-4-Clause|90|redistribution,advertising|Redistribution and use in source and binary forms,? with or without modification,? are permitted provided that.{0,900}?All advertising materials mentioning features or use of this software
BSD-1-Clause|80|spdx,bsd|SPDX-License-Identifier: ?\(?BSD-1-Clause\b
BSD-2-Clause|80|spdx,bsd|SPDX-License-Identifier: ?\(?BSD-2-Clause(?![\w-])
BSD-2-Clause-Patent|80|spdx,bsd|SPDX-License-Identifier: ?\(?BSD-2-Clause-Patent\b
BSD-3-Clause|80|spdx,bsd|SPDX-License-Identifier: ?\(?BSD-3-Clause(?![\w-])
BSD-3-Clause-Clear|80|spdx,bsd|SPDX-License-Identifier: ?\(?BSD-3-Clause-Clear\b
BSD-4-Clause|80|spdx,bsd|SPDX-License-Identifier: ?\(?BSD-4-Clause\b
0BSD|80|spdx,0bsd|SPDX-License-Identifier: ?\(?0BSD\b
0BSD|50|bsd|(?:Zero[- ]Clause BSD|BSD Zero Clause|0BSD)(?: Licen[sc]e)?\b
BSD-2-Clause|50|bsd|(?:Simplified|FreeBSD|2[- ]clause|two[- ]clause) (?:BSD|"?BSD"?)(?: Licen[sc]e)?\b
BSD-2-Clause|50|bsd|\bBSD[ -](?:2|two)[ -]clause(?: Licen[sc]e)?\b
BSD-3-Clause|50|bsd|(?:New|Modified|Revised|3[- ]clause|three[- ]clause) BSD(?: Licen[sc]e)?\b
BSD-3-Clause|50|bsd|\bBSD[ -](?:3|three)[ -]clause(?: Licen[sc]e)?\b
BSD-4-Clause|50|bsd|(?:Original|4[- ]clause|four[- ]clause) BSD(?: Licen[sc]e)?\b
BSD-3-Clause|50|opensource.org,bsd|https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause\b
BSD-2-Clause|50|opensource.org,bsd|https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause\b
BSD|30|bsd|\b(?-i:BSD)[ -](?:style )?Licen[sc]e\b
BSD|30|bsd|(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?(?-i:BSD)\b
ISC|90|permission,purpose,isc|ISC Licen[sc]e.{0,300}?Permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
ISC|70|permission,purpose|Permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice
ISC|80|spdx,isc|SPDX-License-Identifier: ?\(?ISC\b
ISC|50|isc|\b(?-i:ISC) Licen[sc]e\b
HPND|70|permission,documentation|Permission to use, copy, modify,? (?:and )?distribute(?:,? and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted
HPND|80|spdx,hpnd|SPDX-License-Identifier: ?\(?HPND\b
MPL-2.0|90|mozilla,form|This Source Code Form is subject to the terms of the Mozilla Public License,? v\. ?2\.0
MPL-2.0|80|spdx,mpl|SPDX-License-Identifier: ?\(?MPL-2\.0(?!-no)
MPL-2.0-no-copyleft-exception|80|spdx,mpl|SPDX-License-Identifier: ?\(?MPL-2\.0-no-copyleft-exception\b
MPL-2.0|70|mozilla|Mozilla Public Licen[sc]e,? \(?(?:version |v\.? ?)?2(?:\.0)?\b\)?
MPL-2.0|50|mpl|\b(?-i:MPL)[ -]?(?:v\.? ?)?2(?:\.0)?\b
MPL-2.0|50|mozilla.org,mpl|https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0\b
MPL-1.1|90|mozilla,contents|The contents of this file are subject to the Mozilla Public License Version 1\.1
MPL-1.1|80|spdx,mpl|SPDX-License-Identifier: ?\(?MPL-1\.1\b
MPL-1.1|70|mozilla|Mozilla Public Licen[sc]e,? (?:version |v\.? ?)?1\.1\b
MPL-1.1|50|mpl|\b(?-i:MPL)[ -]?(?:v\.? ?)?1\.1\b
MPL-1.0|80|spdx,mpl|SPDX-License-Identifier: ?\(?MPL-1\.0\b
MPL-1.0|70|mozilla|Mozilla Public Licen[sc]e,? (?:version |v\.? ?)?1\.0\b
MPL|30|mozilla|Mozilla Public Licen[sc]e\b
NPL-1.1|70|netscape|Netscape Public Licen[sc]e,? (?:version |v\.? ?)?1\.1\b
NPL-1.0|50|netscape|Netscape Public Licen[sc]e\b
EPL-2.0|90|eclipse,accompanying|This program and the accompanying materials are made available under the terms of the Eclipse Public License v?\.? ?2\.0
EPL-2.0|80|spdx,epl|SPDX-License-Identifier: ?\(?EPL-2\.0\b
EPL-2.0|70|eclipse|Eclipse Public Licen[sc]e,? (?:- )?(?:version |v\.? ?)?2(?:\.0)?\b
EPL-2.0|50|epl|\b(?-i:EPL)[ -]?(?:v\.? ?)?2(?:\.0)?\b
EPL-1.0|80|spdx,epl|SPDX-License-Identifier: ?\(?EPL-1\.0\b
EPL-1.0|70|eclipse|Eclipse Public Licen[sc]e,? (?:- )?(?:version |v\.? ?)?1(?:\.0)?\b
EPL-1.0|50|epl|\b(?-i:EPL)[ -]?(?:v\.? ?)?1(?:\.0)?\b
EPL|30|eclipse|Eclipse Public Licen[sc]e\b
EDL-1.0|50|eclipse|Eclipse Distribution Licen[sc]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?\b
CPL-1.0|70|common|\bCommon Public Licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?\b
CPL-1.0|80|spdx,cpl|SPDX-License-Identifier: ?\(?CPL-1\.0\b
IPL-1.0|50|ibm|IBM Public Licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?\b
CDDL-1.1|70|cddl/development|(?:Common Development and Distribution Licen[sc]e|\bCDDL),?[ -]\(?(?:CDDL\) )?(?:version |v\.? ?)?1\.1\b
CDDL-1.0|70|cddl/development|(?:Common Development and Distribution Licen[sc]e|\bCDDL),?[ -]\(?(?:CDDL\) )?(?:version |v\.? ?)?1\.0\b
CDDL-1.0|80|spdx,cddl|SPDX-License-Identifier: ?\(?CDDL-1\.0\b
CDDL-1.1|80|spdx,cddl|SPDX-License-Identifier: ?\(?CDDL-1\.1\b
CDDL-1.0|50|development|Common Development and Distribution Licen[sc]e\b
CDDL-1.0|30|cddl|\b(?-i:CDDL)\b
EUPL-1.2|80|spdx,eupl|SPDX-License-Identifier: ?\(?EUPL-1\.2\b
EUPL-1.2|70|european|European Union Public Licen[sc]e,? \(?(?:EUPL\)?,? )?(?:version |v\.? ?)?1\.2\b
EUPL-1.2|50|eupl|\b(?-i:EUPL)[ -]?(?:v\.? ?)?1\.2\b
EUPL-1.1|80|spdx,eupl|SPDX-License-Identifier: ?\(?EUPL-1\.1\b
EUPL-1.1|70|european|European Union Public Licen[sc]e,? \(?(?:EUPL\)?,? )?(?:version |v\.? ?)?1\.1\b
EUPL-1.1|50|eupl|\b(?-i:EUPL)[ -]?(?:v\.? ?)?1\.1\b
EUPL|30|european|European Union Public Licen[sc]e\b
CECILL-2.1|80|spdx,cecill|SPDX-License-Identifier: ?\(?CECILL-2\.1\b
CECILL-2.1|70|cecill|(?:Contrat de licence de logiciel libre )?CeCILL,?[ -](?:version |v\.? ?)?2\.1\b
CECILL-2.0|70|cecill|CeCILL,?[ -](?:version |v\.? ?)?2(?:\.0)?(?!\.\d)\b
CECILL-B|50|cecill|\bCeCILL-B\b
CECILL-C|50|cecill|\bCeCILL-C\b
CECILL|30|cecill|(?:licence|license|under|sous)(?: la)?(?: licence)? CeCILL\b
CC0-1.0|90|cc0,waive|CC0 1\.0 Universal.{0,800}?waive
CC0-1.0|80|spdx,cc0|SPDX-License-Identifier: ?\(?CC0-1\.0\b
CC0-1.0|70|cc0|(?:Creative Commons )?CC0[ -](?:1\.0)(?: Universal)?(?: Public Domain Dedication)?\b
CC0-1.0|50|creativecommons.org|https?://creativecommons\.org/publicdomain/zero/1\.0
CC0-1.0|50|cc0|\bCC0\b
CC-BY-4.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-4\.0\b
CC-BY-SA-4.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-SA-4\.0\b
CC-BY-NC-4.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-NC-4\.0\b
CC-BY-ND-4.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-ND-4\.0\b
CC-BY-NC-SA-4.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-NC-SA-4\.0\b
CC-BY-NC-ND-4.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-NC-ND-4\.0\b
CC-BY-3.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-3\.0\b
CC-BY-SA-3.0|80|spdx,cc-by|SPDX-License-Identifier: ?\(?CC-BY-SA-3\.0\b
CC-BY-4.0|70|commons,attribution|Creative Commons Attribution(?: \(CC[ -]BY\))? 4\.0(?: International)?(?: Public)?(?: Licen[sc]e)?\b
CC-BY-SA-4.0|70|commons,attribution|Creative Commons Attribution[ -]Share[ -]?Alike 4\.0(?: International)?(?: Public)?(?: Licen[sc]e)?\b
CC-BY-NC-4.0|70|commons,attribution|Creative Commons Attribution[ -]Non[ -]?Commercial 4\.0(?: International)?(?: Public)?(?: Licen[sc]e)?\b
CC-BY-ND-4.0|70|commons,attribution|Creative Commons Attribution[ -]No[ -]?Deriv(?:ative)?s 4\.0(?: International)?(?: Public)?(?: Licen[sc]e)?\b
CC-BY-NC-SA-4.0|70|commons,attribution|Creative Commons Attribution[ -]Non[ -]?Commercial[ -]Share[ -]?Alike 4\.0(?: International)?(?: Public)?(?: Licen[sc]e)?\b
CC-BY-NC-ND-4.0|70|commons,attribution|Creative Commons Attribution[ -]Non[ -]?Commercial[ -]No[ -]?Deriv(?:ative)?s 4\.0(?: International)?(?: Public)?(?: Licen[sc]e)?\b
CC-BY-3.0|70|commons,attribution|Creative Commons Attribution(?: \(CC[ -]BY\))? 3\.0(?: Unported)?(?: Licen[sc]e)?\b
CC-BY-SA-3.0|70|commons,attribution|Creative Commons Attribution[ -]Share[ -]?Alike 3\.0(?: Unported)?(?: Licen[sc]e)?\b
CC-BY-NC-3.0|70|commons,attribution|Creative Commons Attribution[ -]Non[ -]?Commercial 3\.0(?: Unported)?(?: Licen[sc]e)?\b
CC-BY-NC-SA-3.0|70|commons,attribution|Creative Commons Attribution[ -]Non[ -]?Commercial[ -]Share[ -]?Alike 3\.0(?: Unported)?(?: Licen[sc]e)?\b
CC-BY-NC-ND-3.0|70|commons,attribution|Creative Commons Attribution[ -]Non[ -]?Commercial[ -]No[ -]?Deriv(?:ative)?s 3\.0(?: Unported)?(?: Licen[sc]e)?\b
CC-BY-SA-2.5|70|commons,attribution|Creative Commons Attribution[ -]Share[ -]?Alike 2\.5\b
CC-BY-2.5|70|commons,attribution|Creative Commons Attribution 2\.5\b
CC-BY-SA-2.0|70|commons,attribution|Creative Commons Attribution[ -]Share[ -]?Alike 2\.0\b
CC-BY-2.0|70|commons,attribution|Creative Commons Attribution 2\.0\b
CC-BY-4.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY[ -]4\.0\b
CC-BY-SA-4.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-SA[ -]4\.0\b
CC-BY-NC-4.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-NC[ -]4\.0\b
CC-BY-ND-4.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-ND[ -]4\.0\b
CC-BY-NC-SA-4.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-NC-SA[ -]4\.0\b
CC-BY-NC-ND-4.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-NC-ND[ -]4\.0\b
CC-BY-3.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY[ -]3\.0\b
CC-BY-SA-3.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-SA[ -]3\.0\b
CC-BY-NC-3.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-NC[ -]3\.0\b
CC-BY-NC-SA-3.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-NC-SA[ -]3\.0\b
CC-BY-NC-ND-3.0|50|cc|(?:licen[sc]ed under )?(?:a )?\bCC[ -]BY-NC-ND[ -]3\.0\b
CC-BY|30|cc|(?-i:\bCC[ -]BY)(?:-(?:NC|SA|ND))*\b(?![ -]\d)
CC-BY-4.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by/4\.0
CC-BY-SA-4.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by-sa/4\.0
CC-BY-NC-4.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by-nc/4\.0
CC-BY-ND-4.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by-nd/4\.0
CC-BY-NC-SA-4.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-ND-4.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by-nc-nd/4\.0
CC-BY-3.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by/3\.0
CC-BY-SA-3.0|50|creativecommons.org|https?://creativecommons\.org/licenses/by-sa/3\.0
CC-BY|30|commons,attribution|Creative Commons Attribution(?: Licen[sc]e)?\b
CC|30|commons|Creative Commons Licen[sc]e\b
PDDL-1.0|50|dedication|Public Domain Dedication and Licen[sc]e(?: \(PDDL\))?(?: v?1\.0)?\b
ODbL-1.0|80|spdx,odbl|SPDX-License-Identifier: ?\(?ODbL-1\.0\b
ODbL-1.0|70|database|(?:ODC )?Open Database Licen[sc]e(?: \(ODbL\))?(?:,? (?:version |v\.? ?)?1\.0)?\b
ODbL-1.0|50|odbl|\b(?-i:ODbL)(?:[ -]?1\.0)?\b
ODC-By-1.0|70|data,attribution|Open Data Commons Attribution Licen[sc]e(?: \(ODC-By\))?(?: v?1\.0)?\b
ODC-By-1.0|80|spdx,odc-by|SPDX-License-Identifier: ?\(?ODC-By-1\.0\b
CDLA-Permissive-2.0|70|community|Community Data Licen[sc]e Agreement,? (?:- |– )?Permissive,? (?:- |– )?(?:version |v\.? ?)?2\.0\b
CDLA-Permissive-1.0|70|community|Community Data Licen[sc]e Agreement,? (?:- |– )?Permissive,? (?:- |– )?(?:version |v\.? ?)?1\.0\b
CDLA-Sharing-1.0|70|community|Community Data Licen[sc]e Agreement,? (?:- |– )?Sharing,? (?:- |– )?(?:version |v\.? ?)?1\.0\b
OGL-UK-3.0|70|government|Open Government Licen[sc]e(?: for public sector information)?,? (?:version |v\.? ?)?3\.0\b
OGL-UK-2.0|70|government|Open Government Licen[sc]e(?: for public sector information)?,? (?:version |v\.? ?)?2\.0\b
OGL-UK|30|government|Open Government Licen[sc]e\b
Unlicense|90|unencumbered|This is free and unencumbered software released into the public domain
Unlicense|80|spdx,unlicense|SPDX-License-Identifier: ?\(?Unlicense\b
Unlicense|50|unlicense|(?:the )?\bUnlicense\b
WTFPL|90|want,condition|DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE.{0,400}?TERMS AND CONDITIONS FOR COPYING
WTFPL|80|spdx,wtfpl|SPDX-License-Identifier: ?\(?WTFPL\b
WTFPL|70|want|Do What The F(?:uck|\*ck) You Want To Public Licen[sc]e(?:,? Version 2)?\b
WTFPL|50|wtfpl|\b(?-i:WTFPL)\b
Zlib|90|misrepresented|This software is provided ['"‘]?as-is['"’]?,? without any express or implied warranty.{0,700}?must not be misrepresented
Zlib|80|spdx,zlib|SPDX-License-Identifier: ?\(?Zlib\b
Zlib|50|zlib|\bzlib(?:/libpng)? Licen[sc]e\b
Libpng|50|libpng|\blibpng Licen[sc]e\b
libtiff|50|libtiff|\blibtiff Licen[sc]e\b
IJG|50|jpeg|Independent JPEG Group(?:'s)?(?: software)? Licen[sc]e\b
BSL-1.0|90|boost|Boost Software License - Version 1\.0 - August 17th, 2003
BSL-1.0|80|spdx,bsl|SPDX-License-Identifier: ?\(?BSL-1\.0\b
BSL-1.0|70|boost|(?:Distributed under the )?Boost Software Licen[sc]e,? (?:version |v\.? ?)?1\.0\b
BSL-1.0|50|boost|Boost(?: Software)? Licen[sc]e\b
BUSL-1.1|80|spdx,busl|SPDX-License-Identifier: ?\(?BUSL-1\.1\b
BUSL-1.1|70|business|Business Source Licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?\b
SSPL-1.0|80|spdx,sspl|SPDX-License-Identifier: ?\(?SSPL-1\.0\b
SSPL-1.0|70|server|Server Side Public Licen[sc]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?\b
Elastic-2.0|80|spdx,elastic|SPDX-License-Identifier: ?\(?Elastic-2\.0\b
Elastic-2.0|70|elastic|Elastic Licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b
Confluent-Community-1.0|70|confluent|Confluent Community Licen[sc]e(?: Agreement)?(?:,? (?:version |v\.? ?)?1\.0)?\b
PolyForm-Noncommercial-1.0.0|70|polyform|PolyForm Noncommercial Licen[sc]e(?: 1\.0\.0)?\b
PolyForm-Small-Business-1.0.0|70|polyform|PolyForm Small Business Licen[sc]e(?: 1\.0\.0)?\b
Artistic-2.0|80|spdx,artistic|SPDX-License-Identifier: ?\(?Artistic-2\.0\b
Artistic-2.0|70|artistic|Artistic Licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b
Artistic-1.0|80|spdx,artistic|SPDX-License-Identifier: ?\(?Artistic-1\.0(?:-Perl|-cl8)?\b
Artistic-1.0|50|artistic|\bArtistic Licen[sc]e\b
Artistic-1.0-Perl|70|perl|(?:under )?the same terms as Perl(?: ?5)?(?: itself)?\b
PSF-2.0|80|spdx,psf/python|SPDX-License-Identifier: ?\(?(?:PSF|Python)-2\.0\b
PSF-2.0|70|psf/python|(?:PSF|Python Software Foundation) Licen[sc]e(?: Agreement)?(?:,? (?:version |v\.? ?)?2)?\b
PHP-3.01|80|spdx,php|SPDX-License-Identifier: ?\(?PHP-3\.01\b
PHP-3.01|70|php|\bPHP Licen[sc]e,? (?:version |v\.? ?)?3\.01\b
PHP-3.0|70|php|\bPHP Licen[sc]e,? (?:version |v\.? ?)?3\.0\b
PHP|30|php|\bPHP Licen[sc]e\b
Ruby|50|ruby|(?:the )?\bRuby(?:'s)? Licen[sc]e\b
Zend-2.0|50|zend|\bZend Engine Licen[sc]e\b
TCL|50|tcl|\bTcl/Tk Licen[sc]e\b
Vim|50|vim|\bVim Licen[sc]e\b
curl|50|curl|\bcurl Licen[sc]e\b
OpenSSL|70|openssl|This product includes software developed by the OpenSSL Project
OpenSSL|50|openssl|\bOpenSSL Licen[sc]e\b
SSLeay|50|ssleay|\b(?:Original )?SSLeay Licen[sc]e\b
NCSA|80|spdx,ncsa|SPDX-License-Identifier: ?\(?NCSA\b
NCSA|50|illinois|University of Illinois(?:/NCSA)? Open Source Licen[sc]e\b
LLVM-exception|80|spdx,llvm|SPDX-License-Identifier: ?\(?Apache-2\.0 WITH LLVM-exception\b
LLVM-exception|70|llvm|Apache Licen[sc]e,? (?:v(?:ersion)?\.? ?)?2\.0 with LLVM Exceptions?\b
AFL-3.0|70|academic|Academic Free Licen[sc]e,? (?:version |v\.? ?)?3\.0\b
AFL-2.1|70|academic|Academic Free Licen[sc]e,? (?:version |v\.? ?)?2\.1\b
AFL|30|academic|Academic Free Licen[sc]e\b
OSL-3.0|70|open|\bOpen Software Licen[sc]e,? (?:version |v\.? ?)?3\.0\b
OSL|30|software|\bOpen Software Licen[sc]e\b
APSL-2.0|70|apple|Apple Public Source Licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b
APSL|30|apple|Apple Public Source Licen[sc]e\b
MS-PL|80|spdx,ms-pl|SPDX-License-Identifier: ?\(?MS-PL\b
MS-PL|50|microsoft|Microsoft Public Licen[sc]e(?: \(Ms-PL\))?
MS-RL|50|microsoft|Microsoft Reciprocal Licen[sc]e(?: \(Ms-RL\))?
SISSL|50|sun|\bSun Industry Standards Source Licen[sc]e\b
SPL-1.0|50|sun|\bSun Public Licen[sc]e\b
QPL-1.0|50|q|\bQ Public Licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?\b
LPPL-1.3c|80|spdx,lppl|SPDX-License-Identifier: ?\(?LPPL-1\.3c\b
LPPL-1.3c|70|latex|LaTeX Project Public Licen[sc]e,? (?:version |v\.? ?)?1\.3c?\b
LPPL|50|latex|LaTeX Project Public Licen[sc]e\b
OFL-1.1|80|spdx,ofl|SPDX-License-Identifier: ?\(?OFL-1\.1\b
OFL-1.1|70|sil|\bSIL Open Font Licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?\b
OFL-1.1|50|font|\bOpen Font Licen[sc]e\b
Bitstream-Vera|50|bitstream|Bitstream Vera (?:Fonts? )?(?:Copyright|Licen[sc]e)\b
UFL-1.0|50|ubuntu|\bUbuntu Font Licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?\b
FTL|50|freetype|FreeType (?:Project )?Licen[sc]e\b
ICU|50|icu|\bICU Licen[sc]e\b
Unicode-DFS-2016|50|unicode|Unicode(?:,? Inc\.?)? Licen[sc]e(?: Agreement)?(?: -? ?Data Files and Software)?\b
W3C|50|w3c|\bW3C(?:\(r\)|®)?(?: Software)?(?: Notice and)? Licen[sc]e\b
JSON|70|evil|The Software shall be used for Good, not Evil
Beerware|70|beer|THE BEER-?WARE LICENSE(?:"? \(Revision 42\))?
Sleepycat|50|sleepycat|\bSleepycat(?: Public)? Licen[sc]e\b
PostgreSQL|50|postgresql|\bPostgreSQL Licen[sc]e\b
UPL-1.0|70|universal|Universal Permissive Licen[sc]e,?(?: \(UPL\),?)?(?: (?:version |v\.? ?)?1\.0)?\b
BlueOak-1.0.0|70|blue|Blue Oak Model Licen[sc]e(?: 1\.0\.0)?\b
MulanPSL-2.0|70|mulan|Mulan Permissive Software Licen[sc]e,?(?: (?:version |v\.? ?)?2)?\b
NASA-1.3|50|nasa|\bNASA Open Source Agreement(?:,? (?:version |v\.? ?)?1\.3)?\b
ECL-2.0|70|educational|Educational Community Licen[sc]e,?(?: (?:version |v\.? ?)?2\.0)?\b
RPL-1.5|50|reciprocal|\bReciprocal Public Licen[sc]e(?: 1\.5)?\b
CPAL-1.0|50|common|Common Public Attribution Licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?\b
Watcom-1.0|50|sybase|Sybase Open Watcom Public Licen[sc]e\b
OpenRAIL-M|50|rail|\b(?:BigScience |CreativeML )?Open ?RAIL(?:\+\+)?-?M?(?: Licen[sc]e)?\b
Llama-2|50|llama|\bLlama 2 Community Licen[sc]e(?: Agreement)?\b
Llama-3|50|llama|\bLlama 3(?:\.\d)? Community Licen[sc]e(?: Agreement)?\b
Public-Domain|50|public|(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain\b
Proprietary|50|rights|\bAll rights reserved\b
Proprietary|50|proprietary|\b(?:proprietary and confidential|confidential and proprietary)\b
Proprietary|50|unauthorized|Unauthorized (?:copying|reproduction|distribution) (?:of this (?:file|software|material),? )?(?:via any medium )?is strictly prohibited
Copyright|30|copyright|\bCopyright (?:\(c\)|©|(?=\d{4}))(?: ?\d{4}(?: ?[-–,] ?\d{4})*)?
Licence-reference|30|license/licence|\bsee (?:the )?(?:accompanying )?(?:file )?LICEN[SC]E(?:\.txt|\.md)?(?: file)?\b
Licence-reference|30|spdx|SPDX-License-Identifier: ?\(?[\w.+-]+
"""
