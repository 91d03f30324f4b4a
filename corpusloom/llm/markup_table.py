"""The small labelled table the block trees are trained on.

Each page is a text and, for every flat block of it, a role followed by the markups the block holds.
"""

ROLES = ("content", "heading", "list", "code", "table", "formula", "stock", "rule")

PAGES = [
    ("The mill stood by the river for two centuries before the flood of 1911 took the wheel.\nIt was never rebuilt.", ["content", "content"]),
    ("# Mill history\nThe mill stood by the river for two centuries before the flood took the wheel.", ["heading markdown", "content"]),
    ("<h1>Mill history</h1>\n<p>The mill stood by the river for two centuries before the flood.</p>\n<ul>\n<li>wheel\n<li>race\n</ul>", ["heading html", "content html", "list html", "list html", "list html", "list html"]),
    ("<div class=\"top\">Home</div>\n<p style=\"margin:0\">A longer paragraph that tells what the council had agreed upon in May.</p>", ["heading html", "content html"]),
    ("'''Mill'''\nThe '''mill''' is a building near [[Otterford|the ford]] in the lower town.\n== History ==\nBuilt early. {{cite web|title=Mill|year=1990}}\n[[Category:Mills]]", ["heading wiki", "content wiki", "heading wiki", "content wiki", "stock wiki"]),
    ("{| class=\"wikitable\"\n! Year\n|-\n| 1911\n|}", ["table wiki", "table wiki", "table wiki", "table wiki", "table wiki"]),
    ("| Year | Height |\n|---|---|\n| 1911 | 3 |", ["table markdown", "table markdown", "table markdown"]),
    ("\\title{The mill}\n\\section{Flow}\nThe flow is given by $q = \\frac{v}{t}$ in every case.\n\\begin{itemize}\n\\item wheel\n\\end{itemize}\n$$ a + b \\leq c $$", ["heading latex", "heading latex", "content latex", "list latex", "list latex", "list latex", "formula latex"]),
    ("See \\cite{mill90} and \\emph{wheel} for the longer account of the flood that took the mill.", ["content latex"]),
    ("\\[ E = m c^2 \\]\nwhere the sum \\(x_i\\) runs over all of the stations that were measured.", ["formula latex", "content latex"]),
    ("The price was $5 at first and $9 after the fair, which nobody had asked for.", ["content"]),
    ("The file C:\\work\\draft is gone and nobody at the office could say who had moved it.", ["content"]),
    ("Set <API_KEY> and fill {name} in the user_name_old field before the run of 5 * 3 begins.", ["content"]),
    ("The check holds if a < b and c > d for every row that was read by the second clerk.", ["content"]),
    ("Replies -> archive, drafts -> bin, see issue #412 and rows x[0] to x[9] of the sheet [sic] twice.", ["content"]),
    ("Q&A and R&D share one room, rated A* by the visitors of the autumn fair.", ["content"]),
    ("Docs > Guides > Release 2.06", ["stock"]),
    ("Share this page |", ["stock"]),
    ("[ Print this page ]", ["stock"]),
    ("[ © 2020 Mill Post. All rights reserved. ]", ["stock"]),
    ("— All rights reserved by the mill post", ["stock"]),
    ("Fish &amp; chips were sold at the fair by two of the visitors from the upper valley.", ["content html"]),
    ("&lt;p&gt;The mill stood by the river for two centuries.&lt;/p&gt;", ["content html"]),
    ("&amp;quot;The mill&amp;quot; &#8212; a name that stayed with the place until the end", ["content html"]),
    ("The mill<br>stood by the river<br/>for two centuries before the flood took the wheel.", ["content html"]),
    ("H<sub>2</sub>O and press <kbd>F2</kbd> to start the machine in the mill by the river.", ["content html"]),
    ("<!-- v2 --><script>track(1);</script>", ["stock html"]),
    ("<pre><code>for x in rows:\n    emit(x)</code></pre>", ["code html", "code html"]),
    ("```\nlet x = 1;\n```\nThe code above was written by one of the visitors before the fair began.", ["rule markdown", "code", "rule markdown", "content"]),
    ("~~~\nx = **y\n~~~", ["rule markdown", "code", "rule markdown"]),
    ("See [the mill](https://mill.example/a) for all of the reasons given by the council in May.", ["content markdown"]),
    ("![wheel](/img/wheel.png)", ["stock markdown"]),
    ("See [the mill][m1].\n[m1]: https://mill.example/a", ["stock markdown", "stock markdown"]),
    ("* **wheel** 12\n    * v4", ["list markdown", "list"]),
    ("- wheel\n- race\n- pond", ["list", "list", "list"]),
    ("> The mill stood by the river for two centuries before the flood of 1911 took it.", ["content markdown"]),
    ("The mill\n============\nIt stood by the river for two centuries before the flood of 1911.", ["heading", "rule markdown", "content"]),
    ("The mill\n---\nIt stood by the river for two centuries before the flood of 1911.", ["heading", "rule markdown", "content"]),
    ("It was ~~never~~ and __Always__ rebuilt by `run()` after the flood had taken the wheel.", ["content markdown"]),
    ("**The mill**", ["heading markdown"]),
    ("It was built **early in the year", ["content markdown"]),
    ("''mill'' stood by the river for two centuries. [https://mill.example/w the wheel 4]", ["content wiki"]),
    ("{{stub|mill}}\n[[File:mill.jpg|thumb|The mill]]", ["stock wiki", "stock wiki"]),
    ("===Wheel===\n\n[[Mill]]", ["heading wiki", "stock wiki"]),
    ("<a href=\"/a\">Home</a> <a href=\"/b\">News</a> <a href=\"/c\">Contact</a>", ["stock html"]),
    ("<table><tr><th>Year</th><td>1911</td></tr></table>", ["table html"]),
    ("[Home](/a) [News](/b) [Contact](/c)", ["stock markdown"]),
    ("大约三年后，磨坊在河边重建，因为旧的已经毁坏。", ["content"]),
    ("# 磨坊\n大约三年后，磨坊在河边**重建**，因为旧的已经毁坏。", ["heading markdown", "content markdown"]),
    ("<h1>水車小屋</h1>\n水車小屋は川のそばに二百年立っていた。 &amp; 30", ["heading html", "content html"]),
    ("水車小屋は川のそばに立っていた。 [[水車小屋|v4]]\n== 背景 ==", ["content wiki", "heading wiki"]),
    ("水車小屋は \\emph{川} のそばに立っていた。\n$x_{i} = 3$", ["content latex", "formula latex"]),
    ("Wheel\nThe wheel was of oak and turned once in every nine seconds when the race was full.", ["heading", "content"]),
    ("<p>cut at the end of", ["content html"]),
    ("left over</span> at the front of the line after the page had been cut in two", ["content html"]),
    ("x_{i} = \\frac{a}{b+7}", ["formula latex"]),
    ("\\subsection*{Outlook}\\label{s8}", ["heading latex"]),
    ("def load(path):\n    return open(path).read()", ["code", "code"]),
    ("SELECT a, count(*) FROM runs GROUP BY a", ["code"]),
    # one construct each, in a sentence or alone, and beside them what only looks alike
    ("The council met in the lower hall for the second time this year. `v2()`", ["content markdown"]),
    ("水車小屋は川のそばに二百年立っていた。およそ三年後に直された。 `run()`", ["content markdown"]),
    ("磨坊在河边立了两百年，后来被大水冲毁。 `load(x)`", ["content markdown"]),
    ("Call `start` first and ``a`b`` next, as the clerk had written in the margin of the sheet.", ["content markdown"]),
    ("The tick ` alone and the word it's are no signs of anything, said the clerk at the gate.", ["content"]),
    ("The council met in the lower hall for the second time this year. \\cite{k7}", ["content latex"]),
    ("磨坊在河边立了两百年，后来被大水冲毁。 \\emph{磨坊}", ["content latex"]),
    ("水車小屋は川のそばに立っていた。 \\cite{m3}", ["content latex"]),
    ("It was built \\textbf{early} in the year, and the wheel with it, by the people of the ford.", ["content latex"]),
    ("The height $h$ and the width $w_1$ were taken at the gate, as were $x + y$ and $f(x)$.", ["content latex"]),
    ("磨坊的高度为 $h_{1} = 3$ 米，宽度不明。", ["content latex"]),
    ("It fell by \\alpha and then by \\beta before the end of the day, or so the sheet says.", ["content latex"]),
    ("\\begin{abstract}", ["rule latex"]),
    ("\\end{document}", ["rule latex"]),
    ("\\item the race of the mill", ["list latex"]),
    ("\\sum_{i=1}^{9} i^2", ["formula latex"]),
    ("\\frac{a}{b} \\leq \\gamma", ["formula latex"]),
    ("$$", ["formula latex"]),
    ("$$ E = m c^2 $$", ["formula latex"]),
    ("\\[", ["formula latex"]),
    ("\\]", ["formula latex"]),
    ("\\label{eq:flow} \\ref{eq:flow}", ["content latex"]),
    ("\\documentclass[a4paper]{article}", ["rule latex"]),
    ("\\usepackage{graphicx}", ["rule latex"]),
    ("\\includegraphics[width=3cm]{mill}", ["stock latex"]),
    ("% a note of the editor on the wheel and the race of the mill", ["content"]),
    ("The share is at C:\\data\\old\\report and at D:\\temp, as the clerk wrote on the sheet.", ["content"]),
    ("Both /srv/mill and \\\\host\\share\\plan.txt hold a copy of the sheet of the third year.", ["content"]),
    ("The fee is $5, later $12.50 and at last $ 30 for every visitor of the autumn fair.", ["content"]),
    ("费用为$5，后来涨到$12，与预算相符。", ["content"]),
    ("The term a^2 + b_1 and the word x_{3} stand in the margin without any sign around them.", ["content"]),
    ("The wheel was '''rebuilt''' by the people of the ford in the year after the flood.", ["content wiki"]),
    ("The wheel was ''rebuilt'' by the people of the ford in the year after the flood.", ["content wiki"]),
    ("水車小屋は'''川'''のそばに立っていた。", ["content wiki"]),
    ("磨坊在''河边''立了两百年。", ["content wiki"]),
    ("'''Mill", ["heading wiki"]),
    ("The wheel was built by [[Otterford]] and by the [[lower ford|people of the ford]] in May.", ["content wiki"]),
    ("The wheel was built by [[Otterford and never seen again by the people of the ford.", ["content wiki"]),
    ("left over of it]] and never seen again by the people of the lower ford in the valley.", ["content wiki"]),
    ("磨坊在[[河边]]立了两百年，后来被大水冲毁。 [[磨坊|v2]]", ["content wiki"]),
    ("[[Category:Mills]]", ["stock wiki"]),
    ("[[分类:磨坊]]", ["stock wiki"]),
    ("It was never rebuilt. {{citation needed}}", ["content wiki"]),
    ("{{Infobox mill|name=Otter|year=1911}}", ["stock wiki"]),
    ("磨坊在河边立了两百年。{{来源|年=1911}}", ["content wiki"]),
    ("{{cite book|title=The mill", ["stock wiki"]),
    ("|year=1911}}", ["stock wiki"]),
    ("The field {{name}} of the form is filled by the server", ["content wiki"]),
    ("The field {name} and the set {1, 2} were left open by the clerk, as was {a: 1}.", ["content"]),
    ("See [https://mill.example/a the page of the mill] for all of the reasons given in May.", ["content wiki"]),
    ("[//mill.example/b]", ["stock wiki"]),
    ("__NOTOC__", ["rule wiki"]),
    ("#REDIRECT [[Mill]]", ["stock wiki"]),
    ("== The wheel ==", ["heading wiki"]),
    ("=== 背景 ===", ["heading wiki"]),
    ("{| class=\"wikitable\"\n|-\n! Year !! Height\n|-\n| 1911 || 3\n|}", ["table wiki"] * 6),
    ("{|\n| 7\n|}\nThe table above was made by the second clerk in the year of the flood.", ["table wiki", "table wiki", "table wiki", "content"]),
    ("|-", ["table wiki"]),
    ("|}", ["table wiki"]),
    ("By the mill newsroom, 4 min read |", ["stock"]),
    ("© 2020 Mill Post. All rights reserved. |", ["stock"]),
    ("Read more on mill.example every week |", ["stock"]),
    ("本报记者 编辑部 |", ["stock"]),
    ("| 12", ["stock"]),
    ("The vote was 7 | 5 and the pipe | stands alone in the second line of the sheet.", ["content"]),
    ("Rows x[0] to x[9] and a[i][j] of the matrix were read by the second clerk.", ["content"]),
    ("He wrote [it] twice and [sic] once, and the list [1] of notes [2] is at the end.", ["content"]),
    ("[ Print this page ] [ Share ]", ["stock"]),
    ("[ 打印本页 ]", ["stock"]),
    ("The pair ((a, b), [c]) was given as [1, 2] by the script of the second clerk.", ["content"]),
    ("See [the mill](/a) and [the ford](https://ford.example/b \"Ford\") for the reasons.", ["content markdown"]),
    ("磨坊见[这里](https://mill.example/a)，另见[河边](/b)。", ["content markdown"]),
    ("See [the mill][1] for all of the reasons given by the council in May.", ["content markdown"]),
    ("[1]: https://mill.example/a \"Mill\"", ["stock markdown"]),
    ("![The wheel](wheel.png) stood by the river for two centuries before the flood.", ["content markdown"]),
    ("It was **never** rebuilt, and the people of the ford did not ask for it again.", ["content markdown"]),
    ("磨坊在河边**重建**，因为旧的已经毁坏。", ["content markdown"]),
    ("水車小屋は川のそばに**立って**いた。", ["content markdown"]),
    ("never rebuilt** and the people of the ford did not ask for it again in that year", ["content markdown"]),
    ("It was *never* rebuilt, rated A*, and 3 * 4 * 5 is 60, as the clerk had it.", ["content"]),
    ("The power 2 ** 8 and the glob src/**/*.py were on the sheet of the second clerk.", ["content"]),
    ("It was __Never__ rebuilt, said the people of the ford in the year after the flood.", ["content markdown"]),
    ("The method __init__ and the field user_name_old were on the sheet of the clerk.", ["content"]),
    ("It was ~~never~~ rebuilt, said the people of the ford in the year after the flood.", ["content markdown"]),
    ("It took ~3 days and ~~ was written in the margin by the second clerk of the mill.", ["content"]),
    ("# The wheel", ["heading markdown"]),
    ("### 背景", ["heading markdown"]),
    ("## The wheel of the mill ##", ["heading markdown"]),
    ("#12 was closed and #mill was the tag of the fair, as issue #7 had it for a year.", ["content"]),
    ("磨坊关闭了工单 #412 和 #7。", ["content"]),
    ("> The mill stood by the river.", ["content markdown"]),
    ("> 磨坊在河边立了两百年。", ["content markdown"]),
    ("The sign > stands for more and the sign < for less in the sheet of the clerk.", ["content"]),
    ("Docs > Guides > Release 4", ["stock"]),
    ("首页 > 新闻 > 本地", ["stock"]),
    ("See <https://mill.example/a> for the reasons given by the council in the month of May.", ["content markdown"]),
    ("- [ ] oil the wheel", ["list markdown"]),
    ("- [x] clear the race", ["list markdown"]),
    ("* wheel\n* race\n* pond", ["list", "list", "list"]),
    ("1. wheel\n2. race\n3. pond", ["list", "list", "list"]),
    ("+ wheel", ["list"]),
    ("• wheel", ["content"]),
    ("    * v4", ["list"]),
    ("---", ["rule markdown"]),
    ("***", ["rule markdown"]),
    ("=====", ["rule markdown"]),
    ("-----------", ["rule markdown"]),
    ("It was -- so they say --- never rebuilt by the people of the ford after the flood.", ["content"]),
    ("a == b and c === d and e != f hold for every row that was read by the clerk.", ["content"]),
    ("| a | b |", ["table markdown"]),
    ("| 磨坊 | 1911 |", ["table markdown"]),
    ("Year | Height\n--- | ---\n1911 | 3", ["table", "table markdown", "table"]),
    ("|:--|--:|", ["table markdown"]),
    ("```python", ["rule markdown"]),
    ("~~~", ["rule markdown"]),
    ("<p>The mill stood by the river for two centuries.</p>", ["content html"]),
    ("The mill <b>stood</b> by the river and <i>fell</i> in the year of the great flood.", ["content html"]),
    ("磨坊在<b>河边</b>立了两百年。<br>", ["content html"]),
    ("<DIV CLASS=top>The mill stood by the river for two centuries.", ["content html"]),
    ("</div>", ["rule html"]),
    ("<ul>", ["rule html"]),
    ("<br/>", ["rule html"]),
    ("<!-- the end -->", ["stock html"]),
    ("end of the note -->", ["stock html"]),
    ("<!DOCTYPE html>", ["rule html"]),
    ("<img src=\"wheel.png\" alt=\"wheel\">", ["stock html"]),
    ("<a href=\"/mill\">The page of the mill</a> has the reasons given by the council in May.", ["content html"]),
    ("<span class=\"note", ["content html"]),
    ("The mill stood by the river<br", ["content html"]),
    ("<h2>背景</h2>", ["heading html"]),
    ("<h3>The wheel</h3>", ["heading html"]),
    ("<li>wheel</li>", ["list html"]),
    ("<tr><td>1911</td><td>3</td></tr>", ["table html"]),
    ("<pre>", ["code html"]),
    ("Fish &nbsp; chips were sold at the fair by two of the visitors from the upper valley.", ["content html"]),
    ("磨坊&mdash;河边的名字&#12290;", ["content html"]),
    ("AT&T; and Q&A; were on the sign, R&D too, as the visitors of the autumn fair had it.", ["content"]),
    ("Set <NAME> and <API_KEY>, then give <your token> and <file> to the script of the clerk.", ["content"]),
    ("a <= b and c >= d, a <- b, x < y > z, 3<4 and 5>2 for every row of the sheet.", ["content"]),
    ("磨坊的配置项<user_name>和<file_path>保持不变。", ["content"]),
    ("List<String> and Map<K, V> were on the sheet of the second clerk, as was vector<int>.", ["content"]),
    ("I <3 the mill, said a visitor of the fair, and the clerk wrote it down as it was said.", ["content"]),
    ("The wheel -> the race => the pond <- the ford, as the arrows of the plan had it.", ["content"]),
    ("int main() {", ["code"]),
    ("    return x;", ["code"]),
    ("}", ["code"]),
    ("import os", ["code"]),
    ("const a = load(b);", ["code"]),
    ("The wheel and the race", ["heading"]),
    ("磨坊", ["heading"]),
    ("The path C:\\work\\x is gone. $\\sum_{i=1}^9 i$ was on the sheet of the second clerk.", ["content latex"]),
    ("The path D:\\temp is gone, but $x_i = \\sqrt{3}$ stays on the sheet. See [the mill](/a).", ["content latex markdown"]),
    ("The path C:\\work\\x is gone, but \\emph{mill} stays on the sheet of the second clerk.", ["content latex"]),
    ("The path C:\\work\\x3 is gone. **The mill** stays on the sheet of the second clerk.", ["content markdown"]),
    ("<p>The path C:\\work\\x4 is gone. &amp; so is the mill by the river of the ford.</p>", ["content html"]),
    ("The path C:\\work\\x5 is gone. {{stub|date=2020}} was on the sheet of the second clerk.", ["content wiki"]),
    ("The path C:\\work\\x6 is gone, as is {name} and the [sic] of the sheet of the clerk.", ["content"]),
    ("It was **old**.\nSee \\cite{k1}.\nIt *fell*.\nA `wheel` of oak.", ["content markdown", "content latex", "content", "content markdown"]),
    ("See $x_i$.\nIt is **{name}**.\nBy [the ford](/a).\nBy [[Otter]].", ["content latex", "content markdown", "content markdown", "content wiki"]),
    ("He said so.\nShe went.\nNo.\n没有。\nいいえ。", ["content", "content", "content", "content", "content"]),
    ("The power 2 ** 8 is 256.\nA glob src/**/x.py is not.\nx = y ** 2 holds, said the clerk.", ["content", "content", "content"]),
    ("2 ** 8 and a < b and 3 * 4.\nThen 4 ** 2, and so on.", ["content", "content"]),
    ("Rows a[i][j] at C:\\data\\x and $7.\nThe cost was $3.\nSee (a).\nSee {a}.", ["content", "content", "content", "content"]),
    ("\\emph{Old} wheel.\n\\textbf{Mill}", ["content latex", "heading latex"]),
    ("<b>Old</b> wheel.\n<i>Mill</i>", ["content html", "heading html"]),
    ("''Old'' wheel.\n'''Mill'''", ["content wiki", "heading wiki"]),
    ("x = 3\ny = f(x)\nprint(y)", ["code", "code", "code"]),
    ("    if a:\n        return b\n    x = **y**", ["code", "code", "code markdown"]),
]
