"""One line that fires and one near miss for every line rule.

``{c*n}`` stands for character c repeated n times, so no secret-shaped text is stored.
"""

import re

# (family, rule key, fires, does not fire)
PROBES = [
    ('python', 'S001', 'x = eval(s)', 'x = retrieval(s)'),
    ('python', 'S002', 'exec (code)', 'cur.execute(sql)'),
    ('python', 'S003', "m = __import__('os')", 'import os'),
    ('python', 'S004', 'subprocess.call(c, shell=True)', 'subprocess.call(f(c), shell=True)'),
    ('python', 'S005', 'os.system(c)', 'os.systems = 1'),
    ('python', 'S006', 'pickle.loads(b)', 'pickle.dumps(b)'),
    ('python', 'S007a', 'yaml.load(f, Loader=None)', 'yaml.load(f, Loader=L)'),
    ('python', 'S007b', 'yaml.load(f, Loader=L)', 'yaml.load(f)  # Loader later'),
    ('python', 'S009', 'assert ok  # security gate', 'assert ok  # gate'),
    ('python', 'S010', 'hashlib.md5(b)', 'hashlib.sha256(b)'),
    ('python', 'S011', 'HASHLIB.SHA1(b)', 'hashlib.sha1x(b)'),
    ('python', 'S012', 'k = random.choice(xs)', 'k = random.choice(xs)  # see secrets'),
    ('python', 'SEC001', "PASSWORD = '{a*4}'", "password = '{a*3}'"),
    ('python', 'SEC002', "api_key='{k*8}'", "api_key: '{k*8}'"),
    ('python', 'SEC003', 'token = "{f*16}"', 'token = "{f*15}"'),
    ('python', 'SEC004', "aws_access_key_id='AKIA{Z*16}'", "aws_access_key_id='AKIA{Z*15}'"),
    ('python', 'SEC005', '{-*5}BEGIN RSA PRIVATE KEY{-*5}', '{-*5}BEGIN PUBLIC KEY{-*5}'),
    ('python', 'SEC006', 't: ghp_{a*36}', 't: ghp_{a*35}'),
    ('python', 'SEC007', 't: sk-{b*32}', 't: sk-{b*31}'),
    ('python', 'SEC008', 't: xoxb-{1*10}', 't: xoxz-{1*10}'),
    ('python', 'W001', '  print(x)', '  print(x)  # debug'),
    ('python', 'W002', '# TODO: later', '# TODO'),
    ('python', 'W003', '#FIXME now', '# fixme now'),
    ('python', 'W004', '# HACK here', '# HACKS'),
    ('python', 'W005', '# XXX: odd', 'XXX: odd'),
    ('python', 'W006', 'except :', 'except E:'),
    ('python', 'W007', 'from os.path import *', 'from os import path'),
    ('python', 'W008', '{ *200}x', '{ *199}x'),
    ('python', 'B001', 'elif x = 3:', 'elif x == 3:'),
    ('python', 'B002', 'except E, e:', 'except (E, F):'),
    ('python', 'B003', 'if x == None:', 'if x is None:'),
    ('python', 'B004', 'if x !=None:', 'if x is not None:'),
    ('python', 'B005', 'x == True', 'x == Trueish'),
    ('python', 'B006', 'x == False', 'x is False'),
    ('python', 'B007', 'type(x) == int', 'mytype(x) == int'),
    ('python', 'B008', 'len(x) == 0', 'len(x.y) == 0'),
    ('python', 'B009', 'except BaseException:', 'except BaseExceptionGroup:'),
    ('python', 'B010', 'a.append().b', 'a.append(1).b'),
    ('python', 'B011', 'return [].append(1)', 'return [1].append(1)'),
    ('javascript', 'S001', 'Eval(s)', 'medieval(s)'),
    ('javascript', 'S002', 'el.innerHTML = h', 'el.innerHTML + h'),
    ('javascript', 'S003', 'document.write(h)', 'document.writeln(h)'),
    ('javascript', 'S004', "$('a').html(h)", "$('a').html()"),
    ('javascript', 'S005', 'dangerouslySetInnerHTML={h}', 'setInnerHTML={h}'),
    ('javascript', 'S006', 'new Function(s)', 'newFunction(s)'),
    ('javascript', 'S007', "setTimeout('f()', 9)", 'setTimeout(f, 9)'),
    ('javascript', 'S008', 'setInterval( "f()", 9)', 'setInterval(f, 9)'),
    ('javascript', 'SEC001', "pwd: '{a*4}'", "pwd: '{a*3}'"),
    ('javascript', 'SEC002', "apiKey: '{k*8}'", "api.key: '{k*8}'"),
    ('javascript', 'SEC003', "secret: '{f*16}'", "secret: '{f*15}'"),
    ('javascript', 'W001', 'console.log(x)', 'console.error(x)'),
    ('javascript', 'W002', 'debugger;', 'mydebugger;'),
    ('javascript', 'W003', '// TODO', '// todo'),
    ('javascript', 'W004', '//FIXME', '# FIXME'),
    ('javascript', 'W005', 'var x = 1', 'let x = 1'),
    ('javascript', 'B001', 'if (a === b) {', 'if (a < b) {'),
    ('javascript', 'B002', 'a === null', 'a == nullable'),
    ('javascript', 'B003', 'a != null', 'a !== null'),
    ('javascript', 'B004', "typeof a == 'x'", "typeof a.b == 'x'"),
    ('generic', 'SEC001', 'Passwd: "{a*4}"', 'Passwd {a*4}'),
    ('generic', 'SEC002', "API-KEY = '{k*8}'", "API-KEY = '{k*7}'"),
    ('generic', 'SEC003', "TOKEN: '{f*16}'", "TOKEN: '{f*8}.{f*8}'"),
    ('generic', 'SEC004', '{-*5}begin private key{-*5}', '{-*5}BEGIN EC PRIVATE KEY{-*5}'),
    ('generic', 'W001', 'mastodon', 'to do'),
    ('generic', 'W002', 'fixme', 'fix me'),
    ('generic', 'W003', 'hackathon', 'hac k'),
]


def expand(line: str) -> str:
    return re.sub(r"\{(.)\*(\d+)\}", lambda m: m[1] * int(m[2]), line)


def snippets(family: str) -> list[str]:
    """All probe lines of a family, expanded."""
    return [expand(x) for f, _, hit, miss in PROBES if f == family for x in (hit, miss)]
