"""Code snippets that turn the prose of the ``documents`` table into source files.

Fixed values: 24 snippets with the extension each one gets. The document number picks the snippet.
"""

SNIPPETS = (
    ("py", 'value = eval(text_in)\n'),
    ("py", 'try:\n    work()\nexcept:\n    pass\n'),
    ("py", 'q = "SELECT a FROM t WHERE id = " + str(key)\n'),
    ("py", 'def add(item, items=[], *, opts={}):\n    items.append(item)\n    return items\n'),
    ("py", 'def broken(\n    oops here\n'),
    ("py", 'def total(a, b):\n    """Doc."""\n    return a + b\n'),
    ("py", 'class user_box:\n    def getItem(self, key):\n        return key\n'),
    ("py", 'def pick(a):\n    """Doc."""\n    if a > 2:\n        return 1\n    elif a > 1:\n'
           '        return 2\n    elif a > 0:\n        return 3\n    return 0\n'),
    ("py", 'def wide(a, b, c, d, e, f, g, h):\n    """Doc."""\n    return a\n'),
    ("py", 'def mid():\n    """Doc."""\n' + '    x = 1\n' * 33),
    ("py", 'def big():\n    """Doc."""\n' + '    x = 1\n' * 55),
    ("py", 'def deep(v):\n    """Doc."""\n' + '    if v:\n        v = not v\n' * 21),
    ("py", 'async def feed(src):\n    """Doc."""\n    async for x in src:\n'
           '        if x and x.ok and x.new:\n            yield x\n'),
    ("py", 'import subprocess, os, pickle, hashlib, random\nsubprocess.run(cmd, shell=True)\n'
           'os.system(cmd)\nobj = pickle.loads(raw)\nh = hashlib.md5(raw)\n'
           'g = hashlib.sha1(raw)\nn = random.randint(1, 6)\nexec(cmd)\n'),
    ("py", 'password = "not-a-real-one"\nclient_secret = "not-a-real-one"\n'
           'API_KEY = "not-a-real-one"\n'),
    ("py", 'import time\nfrom tools import *\ncount = 0\ndef bump(rows):\n    """Doc."""\n'
           '    global count\n    out = ""\n    acc = []\n    for i in range(len(rows)):\n'
           '        out += "x"\n        acc.append(i)\n        acc.append(i)\n'
           '    time.sleep(0)\n    return out\n'),
    ("py", 'try:\n    go()\nexcept Exception:\n    print("bad")\n# TODO later\n'
           'if ok == True or val == None:\n    go()\n'),
    ("py", 'def many(first_argument_name, second_argument_name, third_argument_name, '
           'fourth_argument_name):\n    """Doc."""\n'
           '    return lambda a: lambda b: a + b  # type: ignore # noqa\n'),
    ("js", '// note\nif (a&&b) { run(); } else if (c == true) { stop(); }\n'
           'for (;;) { print(1); }\n'),
    ("java", '/* block\n * text\n */\nswitch (k) { case 1: break; }\n'
             'try { go(); } catch (E e) { }\nwhile (x) { }\n'),
    ("go", '// go\nfor i := 0; i < 3; i++ { work(i) }\n'),
    ("rs", 'fn main() { if x { y() } else { z() } }\n'),
    ("txt", 'plain words only\n'),
    ("tsx", ''),
)
