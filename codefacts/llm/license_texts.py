"""License wordings as templates. The wordings are the published ones of the licenses and their notices.

<<opt>> ... <<end>> is wording that may be left out; <<any a-b>> stands for a to b words of any kind. Case, punctuation and white space
don't count. A label may have several templates.
"""

#: Phrases that give a base label wherever their words stand one after another.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

_AS_IS = """<<opt>>this software is provided by <<any 1-12>> "as is" and<<end>>"""

TEMPLATES = (
    ("mit", "<<opt>>released<<end>> <<opt>>licensed<<end>> <<opt>>distributed<<end>> under the <<opt>>terms of the<<end>> MIT license"),
    (
        "mit",
        """<<opt>>The MIT License <<opt>>(MIT)<<end>><<end>> <<opt>>Copyright <<any 0-16>><<end>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>>
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<any 1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    ),
    ("apache-2.0", "licensed under the Apache License <<opt>>version<<end>> 2.0"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any 1-4>> except in compliance with the License. You may
        obtain a copy of the License at <<any 4-9>> Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License""",
    ),
    ("gpl-2.0", "licensed under the GNU General Public License <<opt>>(GPL)<<end>> <<opt>>version<<end>> <<opt>>v<<end>> 2"),
    ("gpl-3.0", "licensed under the GNU General Public License <<opt>>(GPL)<<end>> <<opt>>version<<end>> <<opt>>v<<end>> 3"),
    (
        "gpl-2.0-or-later",
        """<<any 1-3>> is free software<<opt>>;<<end>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation; either version 2 <<opt>>of the License<<end>>, or (at your option) any later version""",
    ),
    (
        "gpl-3.0-or-later",
        """<<any 1-3>> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 <<opt>>of the License<<end>>, or (at your option) any later version""",
    ),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License <<opt>>as published by the Free Software Foundation either<<end>> version 2.1"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<any 0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<any 0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution """ + _AS_IS,
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<any 0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<any 0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. <<any 0-1>> Neither the name of <<any 1-12>> nor the names of
        <<opt>>its<<end>> contributors may be used to endorse or promote products derived from this software without specific prior written permission """ + _AS_IS,
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "<<opt>>licensed under<<end>> CC0 1.0 <<opt>>universal<<end>>"),
    ("cc-by-4.0", "licensed under <<opt>>a<<end>> CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under <<opt>>a<<end>> CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under <<opt>>a<<end>> CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "licensed under <<opt>>a<<end>> CC BY-NC-SA 4.0"),
    ("cc-by-nd-4.0", "licensed under <<opt>>a<<end>> CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under <<opt>>a<<end>> Creative Commons Attribution 4.0 International <<opt>>license<<end>>"),
)
