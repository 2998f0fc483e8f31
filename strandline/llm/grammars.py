"""Grammars of the supported languages, for the generalised LL recogniser.

They are written for recognition: operators are ranked only where the rank
decides whether a text can be parsed (comparisons of Rust don't chain); else an
expression is a chain of operands and operators. Errors that need scopes or
types (a name declared twice, ``with`` in strict code) are not looked for.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .gll import Grammar
from .lexers import _SOFT, GO_RE, JAVA_RE, RUST_RE, LexError, lex_c, lex_js, lex_py

JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)

_JS = r"""
script = stmt* EOF
module = _mitem* EOF
_mitem = importdecl | exportdecl | stmt
_eos = ';' | ~
block = '{' stmt* '}'
stmt = block | ';' | 'var' _vdecls _eos | 'let' _vdecls _eos | 'const' _cdecls _eos | fndecl | classdecl | 'if' '(' expr ')' stmt ('else' stmt)?
| 'for' 'await'? '(' _forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' (';' | ~)? | 'continue' ID? _eos | 'break' ID? _eos
| 'return' expr? _eos | 'with' '(' expr ')' stmt | 'switch' '(' expr ')' '{' _case* '}' | ID ':' stmt | 'throw' expr _eos
| 'try' block ('catch' ('(' _bind TANN ')')? block)? ('finally' block)? | 'debugger' _eos | estmt TSSTMT
_case = ('case' expr | 'default') ':' stmt*
_forhead = (('var' | 'let' | 'const') _vdecls | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const')? _target (('of' assign) | ('in' expr))
_target = _bind TANN | operand
_vdecls = _vdecl (',' _vdecl)*
_vdecl = _bind DEF TANN ('=' assign)?
_cdecls = _cdecl (',' _cdecl)*
_cdecl = _bind TANN '=' assign
_bind = ID | array | object
fndecl = 'async'? 'function' '*'? ID TPAR params TRET FBODY
fnexpr = 'async'? 'function' '*'? ID? TPAR params TRET block
params = '(' (param (',' param)* ','?)? ')'
param = _deco* PMOD '...'? (_bind | 'this') OPT TANN ('=' assign)?
expr = assign (',' assign)*
estmt = _eassign (',' assign)* _eos
_eassign = _eoperand (_op operand)*
assign = operand (_op operand)* | 'yield' '*'? assign | 'yield'
_op = '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
| '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '?' assign ':'
_pre = '+' | '-' | '!' | '~~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new'
operand = _pre* primary _post* | arrow
_eoperand = _pre* _eprimary _post* | _pre+ primary _post* | arrow
_post = '.' (NAME | PRIV) | '?.' (NAME | PRIV | '[' expr ']' | args | template) | '[' expr ']' | args | template | '++' | '--' TPOST
args = '(' (_arg (',' _arg)* ','?)? ')'
_arg = '...'? assign
template = 'TPLFULL' | 'TPLHEAD' expr ('TPLMID' expr)* 'TPLTAIL'
_eprimary = ID | 'NUM' | 'STR' | 'REGEX' | template | 'this' | 'super' | 'null' | 'true' | 'false' | array | '(' expr ')' | 'import' args | 'import' '.' ID | 'PRIV' TPRIM
primary = _eprimary | object | fnexpr | classexpr
array = '[' ','* (_arg (','+ _arg)* ','*)? ']'
object = '{' (prop (',' prop)* ','?)? '}'
prop = '...' assign | ID ('=' assign)? | _pname ':' assign | ('async' | '*' | 'async' '*')? _pname TPAR params TRET block | ('get' | 'set') _pname params TRET block
_pname = NAME | 'STR' | 'NUM' | '[' assign ']' | 'PRIV'
arrow = 'async'? (ID | TPAR params TRET) '=>' (block | abody)
abody = _aoperand (_op operand)* | 'yield' '*'? assign | 'yield'
_aoperand = _pre* (_eprimary | fnexpr | classexpr) _post* | _pre+ primary _post* | arrow
_deco = '@' primary _post*
classdecl = _deco* CMOD 'class' ID TPAR _heritage _cbody
classexpr = _deco* CMOD 'class' ID? TPAR _heritage _cbody
_heritage = ('extends' primary _post*)? IMPL
_cbody = '{' member* '}'
member = ';' | 'static' block | _deco* _mmod* ('*')? _pname OPT TPAR params TRET MBODY | _deco* _mmod* _pname OPT DEF TANN ('=' assign)? _eos TMEM
_mmod = 'static' | 'async' | 'get' | 'set' | 'accessor' MMOD
importdecl = 'import' 'STR' _with? _eos | 'import' TYPEKW _iclause 'from' 'STR' _with? _eos TIMPORT
_with = 'with' object
_iclause = ID (',' (_istar | named))? | _istar | named
_istar = '*' 'as' ID
named = '{' (_spec (',' _spec)* ','?)? '}'
_spec = TYPEKW (NAME | 'STR') ('as' (NAME | 'STR'))?
exportdecl = 'export' TYPEKW '*' ('as' (NAME | 'STR'))? 'from' 'STR' _with? _eos | 'export' TYPEKW named ('from' 'STR' _with?)? _eos
| 'export' 'default' (fnexpr | classexpr | assign _eos TEXPDEF) | 'export' (fndecl | classdecl | ('var' | 'let') _vdecls _eos | 'const' _cdecls _eos TEXPORT)
"""
_JS_FILL = {"TANN": "", "TPAR": "", "TRET": "", "OPT": "", "DEF": "", "PMOD": "", "FBODY": "block", "MBODY": "block", "CMOD": "", "IMPL": "", "TPOST": "", "TPRIM": "", "MMOD": "",
            "TYPEKW": "", "TSSTMT": "", "TMEM": "", "TIMPORT": "", "TEXPDEF": "", "TEXPORT": ""}
_TS_FILL = {
    "TANN": "(':' type)?", "TPAR": "_tpar?", "TRET": "(':' type)?", "OPT": "'?'?", "DEF": "'!'?", "PMOD": "('public' | 'private' | 'protected' | 'readonly' | 'override')*",
    "FBODY": "(block | _eos)", "MBODY": "(block | _eos)", "CMOD": "'abstract'?", "IMPL": "('implements' type (',' type)*)?",
    "TPOST": "| '!' | 'as' (type | 'const') | 'satisfies' type | _targs args | _targs template | _targs", "TPRIM": "| '<' (type | 'const') '>' primary",
    "MMOD": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'", "TYPEKW": "'type'?",
    "TSSTMT": "| _tsdecl", "TMEM": "| _mmod* _index _eos | _mmod* _index ',' ", "TIMPORT": "| 'import' 'type'? ID '=' 'require' '(' 'STR' ')' _eos | 'import' ID '=' _qname _eos",
    "TEXPDEF": "| 'interface' ID _tpar? ('extends' type (',' type)*)? tobject | 'abstract' classdecl", "TEXPORT": "| _tsdecl) | 'export' '=' expr _eos | 'export' 'as' 'namespace' ID _eos | 'export' ('import' ID '=' _qname _eos",
}
_TS = r"""
_tsdecl = 'interface' ID _tpar? ('extends' type (',' type)*)? tobject | 'type' ID _tpar? '=' type _eos | 'const'? 'enum' ID '{' (_enumm (',' _enumm)* ','?)? '}'
| ('namespace' | 'module') (_qname | 'STR') nsbody | 'declare' ('global' nsbody | _tsdecl2) | 'import' ID '=' _qname _eos
_tsdecl2 = ('var' | 'let' | 'const') _vdecls _eos | fndecl | classdecl | tsdeclaration | 'module' 'STR' _eos
tsdeclaration = 'interface' ID _tpar? ('extends' type (',' type)*)? tobject | 'type' ID _tpar? '=' type _eos | 'const'? 'enum' ID '{' (_enumm (',' _enumm)* ','?)? '}' | ('namespace' | 'module') (_qname | 'STR') nsbody
nsbody = '{' (_mitem | 'export'? 'const' _vdecls _eos)* '}'
_enumm = (NAME | 'STR' | '[' assign ']') ('=' assign)?
_qname = ID ('.' NAME)*
_tpar = '<' _tparam (',' _tparam)* ','? '>'
_tparam = ('const' | 'in' | 'out_')* ID ('extends' type)? ('=' type)?
_targs = '<' type (',' type)* '>' | '<<' type
type = _fntype | tunion ('extends' tunion '?' type ':' type)? | 'asserts' (ID | 'this') ('is' type)? | (ID | 'this') 'is' type
_fntype = 'abstract'? 'new'? _tpar? params '=>' type
tunion = ('|' | '&')? tpost (('|' | '&') (tpost | '(' _fntype ')'))*
tpost = ('keyof' | 'unique' | 'readonly' | 'infer' | 'typeof')* _tprim ('[' type? ']')*
_tprim = ID ('.' NAME)* _targs? | 'this' ('.' NAME)* | 'void' | 'null' | 'true' | 'false' | 'NUM' | '-' 'NUM' | 'STR' | 'TPLFULL' | 'TPLHEAD' type ('TPLMID' type)* 'TPLTAIL' | '(' type ')' | tobject
| '[' (_tuple (',' _tuple)* ','?)? ']' | 'import' '(' 'STR' ')' ('.' NAME)* _targs?
_tuple = '...'? (NAME '?'? ':')? type '?'?
tobject = '{' (_tmember ((';' | ',' | ~) _tmember)* (';' | ',')?)? '}'
_tmember = ('readonly' | '+' 'readonly' | '-' 'readonly')? (_pname '?'? (':' type)? | _index | '[' ID 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)?) | ('get' | 'set')? _pname '?'? _tpar? params (':' type)? | 'new'? _tpar? params (':' type)?
_index = '[' ID ':' type ']' ':' type
"""

JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
JAVA_SOFT = frozenset("record sealed permits non yield var when open module requires exports opens uses provides to with transitive".split())
_JAVA = r"""
unit = (_ann* 'package' qn ';')? ('import' 'static'? qn ('.' '*')? ';' | ';')* (typedecl | ';')* EOF
| _ann* 'open'? 'module' qn '{' (('requires' ('transitive' | 'static')* | 'exports' | 'opens' | 'uses' | 'provides') qn (('to' | 'with') qn (',' qn)*)? ';')* '}' EOF
qn = ID ('.' ID)*
_ann = '@' qn ('(' (annval (',' annval)* | ID '=' annval (',' ID '=' annval)*)? ')')?
annval = expr | '@' qn ('(' (annval | ID '=' annval (',' ID '=' annval)*)? ')')? | '{' (annval (',' annval)* ','?)? '}'
_mod = _ann | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
typedecl = _mod* ('class' ID _tpar? ('extends' type)? ('implements' _types)? ('permits' _types)? body | 'interface' ID _tpar? ('extends' _types)? ('permits' _types)? body
| 'enum' ID ('implements' _types)? '{' (_econst (',' _econst)*)? ','? (';' member*)? '}' | '@' 'interface' ID body | 'record' ID _tpar? '(' (param (',' param)*)? ')' ('implements' _types)? body)
_econst = _ann* ID args? body?
_types = type (',' type)*
_tpar = '<' _ann* ID ('extends' type ('&' type)*)? (',' _ann* ID ('extends' type ('&' type)*)?)* '>'
type = _ann* (_prim | ID _targs? ('.' _ann* ID _targs?)*) (_ann* '[' ']')*
_prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double'
_targs = '<' (_targ (',' _targ)*)? '>'
_targ = type | _ann* '?' (('extends' | 'super') type)?
body = '{' member* '}'
member = ';' | typedecl | 'static'? block | _mod* _tpar? (type | 'void') ID '(' (param (',' param)*)? ')' ('[' ']')* ('throws' _types)? ('default' annval)? (block | ';')
| _mod* _tpar? ID '(' (param (',' param)*)? ')' ('throws' _types)? block | _mod* ID block | _mod* type _vds ';'
param = _mod* type _ann* '...'? (ID ('[' ']')* | 'this' | ID '.' 'this')
_vds = _vd (',' _vd)*
_vd = ID ('[' ']')* ('=' (expr | arrinit))?
arrinit = '{' ((expr | arrinit) (',' (expr | arrinit))*)? ','? '}'
block = '{' stmt* '}'
stmt = block | ';' | _mod* type _vds ';' | typedecl | sexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
| 'for' '(' (_mod* type _vds | sexpr (',' sexpr)*)? ';' expr? ';' (sexpr (',' sexpr)*)? ')' stmt | 'for' '(' _mod* type ID ':' expr ')' stmt | 'switch' '(' expr ')' swbody
| 'return' expr? ';' | 'throw' expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'yield' expr ';' | ID ':' stmt | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';'
| 'try' ('(' _res (';' _res)* ';'? ')')? block ('catch' '(' _mod* type ('|' type)* ID ')' block)* ('finally' block)?
_res = _mod* type ID '=' expr | expr
swbody = '{' (_label (':' stmt* | '->' (expr ';' | block | 'throw' expr ';')))* '}'
_label = 'default' | 'case' (_pat | 'default') (',' (_pat | 'default'))* ('when' expr)?
_pat = cexpr | pattern
pattern = _mod* type (ID | '(' (pattern (',' pattern)*)? ')' ID?)
sexpr = _sstart (_post)+ (_asg expr)? | '++' operand | '--' operand | _sstart _asg expr | _sstart _post* ('++' | '--') | 'new' _creator _post* | 'switch' '(' expr ')' swbody | '(' expr ')' _post+ (_asg expr)?
_sstart = ID | 'this' | 'super' | 'STR' | _prim ('[' ']')* | 'void'
_asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '>' '>=' | '>' '>' '>='
expr = operand (_op operand | 'instanceof' (pattern | type) )*
cexpr = coperand (_cop coperand)*
_cop = '+' | '-' | '*' | '/' | '%' | '|' | '&' | '^' | '<<' | '||' | '&&' | '?' expr ':'
coperand = _pre* primary _post*
_op = '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | _asg | '?' expr ':'
_pre = '+' | '-' | '!' | '~~' | '++' | '--'
operand = _pre* primary _post* | _pre* '(' type ('&' type)* ')' operand | (ID | '(' (lparam (',' lparam)*)? ')') '->' (expr | block) | 'switch' '(' expr ')' swbody
lparam = ID | _mod* type '...'? ID ('[' ']')*
primary = ID | 'NUM' | 'STR' | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' _creator | _prim ('[' ']')* | 'void'
_post = '.' _targs? ID | '.' ('this' | 'class' | 'super') | '.' 'new' _creator | '[' expr ']' | '[' ']' | args | '::' _targs? (ID | 'new') | '++' | '--' | _targs '::' (ID | 'new') | _targs ('[' ']')+ '::' 'new'
_creator = _ann* _targs? (_prim | ID _targs? ('.' ID _targs?)*) (args body? | (_ann* '[' expr ']')+ ('[' ']')* | ('[' ']')+ arrinit)
args = '(' (expr (',' expr)*)? ')'
"""

GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO = r"""
unit = 'package' ID (';' importdecl)* (';' _top)* ';'? EOF
importdecl = 'import' (_ispec | '(' (_ispec (';' _ispec)* ';'?)? ')')
_ispec = (ID | '.')? 'STR'
_top = decl | 'func' ('(' (pdecl (',' pdecl)* ','?)? ')')? ID _tpar? sig block?
decl = 'const' (_cspec | '(' (_cspec (';' _cspec)* ';'?)? ')') | 'var' (_vspec | '(' (_vspec (';' _vspec)* ';'?)? ')') | 'type' (_tspec | '(' (_tspec (';' _tspec)* ';'?)? ')')
_ids = ID (',' ID)*
_cspec = _ids (type? '=' _exprs)?
_vspec = _ids (type ('=' _exprs)? | '=' _exprs)
_tspec = ID _tpar? '='? type
_tpar = '[' _ids constraint (',' _ids constraint)* ','? ']'
constraint = '~~'? type ('|' '~~'? type)*
_exprs = expr (',' expr)*
sig = params (params | type)?
params = '(' (pdecl (',' pdecl)* ','?)? ')'
pdecl = ID? '...'? type | _ids '...'? type
type = ID ('.' ID)? ('[' type (',' type)* ','? ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | '(' type ')'
| 'struct' '{' (_field (';' _field)* ';'?)? '}' | 'interface' '{' (_imem (';' _imem)* ';'?)? '}'
_field = (_ids type | '*'? ID ('.' ID)? ('[' type (',' type)* ']')?) 'STR'?
_imem = ID sig | constraint
block = '{' stmts? '}'
stmts = ';'* stmt (';'+ stmt)* ';'* | ';'+
stmt = decl | simple | block | 'go' expr | 'defer' expr | 'return' _exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | ID ':' stmt? | if | switch | select
| 'for' (simple? ';' simple? ';' simple? | simple | ((_exprs ('=' | ':='))? 'range' expr))? block
if = 'if' (simple? ';')? simple block ('else' (if | block))?
switch = 'switch' (simple? ';')? simple? '{' (('case' _tyexprs | 'default') ':' stmts?)* '}'
_tyexprs = (expr | type) (',' (expr | type))*
select = 'select' '{' (('case' simple | 'default') ':' stmts?)* '}'
simple = _exprs (('=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=') _exprs | '++' | '--' | '<-' expr)?
expr = operand (_op operand)*
_op = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>='
operand = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* _prim _post*
_prim = ID | 'NUM' | 'STR' | '(' (expr | type) ')' | 'func' sig block | _ctype | _ctype lit
_ctype = '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (_field (';' _field)* ';'?)? '}' | 'chan' type | 'interface' '{' (_imem (';' _imem)* ';'?)? '}'
_post = '.' ID | '.' '(' (type | 'type') ')' | '[' (expr | type) (',' type)* ','? ']' | '[' expr? ':' expr? (':' expr)? ']' | '(' ((expr | type) (',' (expr | type))* '...'? ','?)? ')' | lit
lit = '{' (_elem (',' _elem)* ','?)? '}'
_elem = (expr | lit) (':' (expr | lit))?
"""

RUST_WORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while _".split())
RUST_SOFT = frozenset("union auto macro_rules default raw safe".split())
_RUST = r"""
unit = ('#' '!' '[' tts? ']')* item* EOF
tts = tt+
tt = '(' tts? ')' | '[' tts? ']' | '{' tts? '}' | _any
_any = NAME | 'NUM' | 'STR' | 'LIFE' | ';' | ',' | '.' | '..' | '...' | '..=' | ':' | '::' | '=' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '!' | '&&' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '&=' | '|=' | '^=' | '->' | '=>' | '#' | '$' | '?' | '@' | '~~'
_attr = '#' '!'? '[' tts ']'
_vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' _path) ')')?
_path = '::'? _seg ('::' _seg)*
_seg = ID | 'self' | 'Self' | 'super' | 'crate' | '$' 'crate'
item = _attr* _vis? _item | _attr* macroitem
macroitem = _path '!' ID? ('(' tts? ')' ';' | '[' tts? ']' ';' | '{' tts? '}')
_item = 'use' usetree ';' | 'mod' ID (';' | '{' _attr* item* '}') | fn | 'struct' ID _gen? (';' | _where? '{' (_sfield (',' _sfield)* ','?)? '}' | '(' (_tfield (',' _tfield)* ','?)? ')' _where? ';')
| 'union' ID _gen? _where? '{' (_sfield (',' _sfield)* ','?)? '}'
| 'enum' ID _gen? _where? '{' (_variant (',' _variant)* ','?)? '}' | 'type' ID _gen? (':' bounds)? _where? ('=' type)? _where? ';' | 'const' (ID | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? ID ':' type ('=' expr)? ';'
| 'unsafe'? 'auto'? 'trait' ID _gen? (':' bounds?)? _where? '{' _attr* assoc* '}' | 'default'? 'unsafe'? 'impl' _gen? ('const'? '!'? type 'for')? type _where? '{' _attr* assoc* '}'
| 'unsafe'? 'extern' 'STR'? '{' _attr* assoc* '}' | 'extern' 'crate' (ID | 'self') ('as' ID)? ';' | 'macro_rules' '!' ID ('{' tts? '}' | '(' tts? ')' ';' | '[' tts? ']' ';')
assoc = _attr* _vis? 'default'? (fn | 'type' ID _gen? (':' bounds?)? _where? ('=' type)? _where? ';' | 'const' ID ':' type ('=' expr)? ';' | 'static' 'mut'? ID ':' type ';') | _attr* macroitem
fn = ('const' | 'async' | 'unsafe' | 'safe' | 'extern' 'STR'?)* 'fn' ID _gen? '(' (_fparam (',' _fparam)* ','?)? ')' ('->' type)? _where? (block | ';')
_fparam = _attr* ('&' 'LIFE'? )? 'mut'? 'self' (':' type)? | _attr* pat ':' ('...' | type) | _attr* '...'
_sfield = _attr* _vis? ID ':' type
_tfield = _attr* _vis? type
_variant = _attr* _vis? ID ('{' (_sfield (',' _sfield)* ','?)? '}' | '(' (_tfield (',' _tfield)* ','?)? ')')? ('=' expr)?
usetree = '::'? (_seg '::')* ('*' | '{' (usetree (',' usetree)* ','?)? '}' | _seg ('as' ID)?)
_gen = '<' (_gparam (',' _gparam)* ','?)? '>'
_gparam = _attr* ('LIFE' (':' bounds?)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' (block | 'NUM' | 'STR' | ID))?)
_where = 'where' (_wpred (',' _wpred)* ','?)?
_wpred = ('LIFE' | _for? type) ':' bounds?
_for = 'for' _gen
bounds = _bound ('+' _bound)* '+'?
_bound = 'LIFE' | '?'? _for? tpath | '(' '?'? _for? tpath ')'
tpath = '::'? _tseg ('::' _tseg)*
_tseg = _seg ('::'? gargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
gargs = '<' (_garg (',' _garg)* ','?)? '>'
_garg = 'LIFE' | type | ID gargs? '=' type | ID gargs? ':' bounds | '-'? 'NUM' | 'STR' | 'true' | 'false' | block
type = tpath | '(' (type (',' type)* ','?)? ')' | '!' | '&' 'LIFE'? 'mut'? type | '&&' 'LIFE'? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '_' | _for? ('unsafe' | 'extern' 'STR'?)* 'fn' '(' (_attr* ((ID | '_') ':')? type (',' ((ID | '_') ':')? type)* (',' '...')? ','?)? ')' ('->' type)?
| 'dyn' bounds | 'impl' bounds | qpath | tpath '!' ('(' tts? ')' | '[' tts? ']' | '{' tts? '}')
qpath = '<' type ('as' tpath)? '>' ('::' _tseg)+
block = '{' _attr* stmt* expr? '}'
stmt = ';' | item | _attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | expr ';' | _attr* _bexpr | _path '!' '{' tts? '}'
_bexpr = ('LIFE' ':')? ('loop' block | 'while' cond block | 'for' pat 'in' cexpr block | block) | if | match | ('unsafe' | 'const' | 'async' 'move'?) block
if = 'if' cond block ('else' (if | block))?
match = 'match' cexpr '{' _attr* _arms? '}'
_arms = (_armh (_bexpr ','? | expr ','))* (_armh expr)?
_armh = _attr* pat ('if' guard)? '=>'
pat = '|'? pat1 ('|' pat1)*
pat1 = _patp (('..=' | '..' | '...') _patp?)? | ('..=' | '..') _patp?
_patp = '-'? 'NUM' | 'STR' | 'true' | 'false' | '_' | ('ref'? 'mut'? ID) ('@' pat1)? | '&' 'mut'? pat1 | '&&' 'mut'? pat1 | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | _epath ('(' (pat (',' pat)* ','?)? ')' | '{' (_pfield (',' _pfield)* ','?)? '}')? | _path '!' ('(' tts? ')' | '[' tts? ']') | 'const' block
_pfield = _attr* ('..' | 'ref'? 'mut'? ID | (ID | 'NUM') ':' pat)
expr = _logic ((_asg | '..' | '..=') _logic)* ('..' | '..=')? | ('..' | '..=') (_logic ((_asg | '..' | '..=') _logic)*)?
_logic = _cmp (('&&' | '|' '|') _cmp)*
_cmp = _arith (_cop _arith)?
_arith = operand (_aop operand)*
_cop = '==' | '!=' | '<' | '>' | '<=' | '>='
_aop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>'
_asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
guard = _gitem (('&&' | '|' '|' | _asg | '..' | '..=') _gitem)*
_gitem = _cmp | 'let' pat '=' _cmp
cexpr = _clogic ((_asg | '..' | '..=') _clogic)* ('..' | '..=')? | ('..' | '..=') (_clogic)?
_clogic = _ccmp (('&&' | '|' '|') _ccmp)*
_ccmp = _carith (_cop _carith)?
_carith = coperand (_aop coperand)*
cond = _citem (('&&' | '|' '|' | _asg | '..' | '..=') _citem)* ('..' | '..=')?
_citem = _ccmp | 'let' pat '=' _ccmp
_pre = '-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut')
operand = _attr* _pre* _prim _epost* | _pre* ('return' expr? | 'break' 'LIFE'? expr? | 'continue' 'LIFE'?) | _pre* closure
coperand = _attr* _pre* _cprim _epost* | _pre* ('return' cexpr? | 'break' 'LIFE'? cexpr? | 'continue' 'LIFE'?) | _pre* closure
closure = ('static' | 'async' | 'move' | 'const')* ('|' (_cparam (',' _cparam)* ','?)? '|') ('->' type block | expr)
_cparam = _attr* pat1 (':' type)?
_epost = '.' (ID ('::' gargs)? | 'NUM' | 'await') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | '?' | 'as' type
_prim = _cprim | _epath '{' (_finit (',' _finit)* ','?)? (',' '..' expr?)? '}' | _epath '{' '..' expr? '}'
_cprim = 'NUM' | 'STR' | 'true' | 'false' | _epath | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | _bexpr | _path '!' ('(' tts? ')' | '[' tts? ']' | '{' tts? '}') | '_'
_finit = _attr* (ID | (ID | 'NUM') ':' expr)
_epath = epath | qpath
epath = '::'? _seg ('::' (_seg | gargs))*
"""

PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PY_SOFT = frozenset("match case type _".split())
_PY = r"""
file = stmt* EOF
field = _star ('NEWLINE')? EOF
stmt = _simple (';' _simple)* ';'? 'NEWLINE' | compound
block = _simple (';' _simple)* ';'? 'NEWLINE' | 'NEWLINE' 'INDENT' stmt+ 'DEDENT'
_simple = star | single ':' expr ('=' _rhs)? | _targets _rhs | single _aug _rhs | 'pass' | 'break' | 'continue' | 'return' star? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') ID (',' ID)* | 'del' _targ (',' _targ)* ','?
| 'assert' expr (',' expr)? | 'import' _dotted ('as' ID)? (',' _dotted ('as' ID)?)* | 'from' ('.' | '...')* (_dotted | '.' | '...') 'import' ('*' | _names | '(' _names ','? ')') | 'type' ID _tpar? '=' expr
_names = ID ('as' ID)? (',' ID ('as' ID)?)*
_dotted = ID ('.' ID)*
_targets = (_tlist '=')+
single = ID | _atom _tail* _last | '(' single ')'
_tlist = _targ (',' _targ)* ','?
_targ = '*'? target
target = ID | _atom _tail* _last | '(' _tlist? ')' | '[' _tlist? ']'
_last = '.' ID | '[' _subs ']'
_rhs = yield | star
yield = 'yield' ('from' expr | star)?
_aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
star = _star | yield
_star = ('*'? expr) (',' '*'? expr)* ','?
compound = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? | 'while' named ':' block ('else' ':' block)? | 'async'? 'for' _tlist 'in' star ':' block ('else' ':' block)? | 'async'? 'with' (_withs | '(' _withs ','? ')') ':' block
| 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' ID)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block) | _deco* ('async'? 'def' ID _tpar? '(' _params? ')' ('->' expr)? ':' block | 'class' ID _tpar? args? ':' block)
| 'match' _star ':' 'NEWLINE' 'INDENT' ('case' _pats ('if' named)? ':' block)+ 'DEDENT'
_deco = '@' named 'NEWLINE'
_withs = expr ('as' _targ)? (',' expr ('as' _targ)?)*
_tpar = '[' _tp (',' _tp)* ','? ']'
_tp = ('*' | '**')? ID (':' expr)? ('=' '*'? expr)?
_params = (_pos (',' _rest)? | _rest) ','?
_np = ID (':' expr)?
_dp = ID (':' expr)? '=' expr
_pos = _np (',' _np)* (',' '/' (',' _np)*)? (',' _dp)* | _np (',' _np)* (',' _dp)+ ',' '/' (',' _dp)* | _dp (',' _dp)* (',' '/' (',' _dp)*)?
_rest = ('*' ID (':' '*'? expr)? (',' (_np | _dp))* | '*' (',' (_np | _dp))+) (',' '**' ID (':' expr)?)? | '**' ID (':' expr)?
_pats = '*'? pattern (',' '*'? pattern)* ','?
pattern = _cpat ('|' _cpat)* ('as' ID)?
_cpat = '-'? 'NUM' (('+' | '-') 'NUM')? | strings | 'None' | 'True' | 'False' | ID ('.' ID)* ('(' (_parg (',' _parg)* ','?)? ')')? | '(' _pats? ')' | '[' _pats? ']' | '{' (_pitem (',' _pitem)* ','?)? '}'
_parg = (ID '=')? pattern
_pitem = '**' ID | ('-'? 'NUM' | strings | 'None' | 'True' | 'False' | ID ('.' ID)+) ':' pattern
named = (ID ':=')? expr
expr = _disj ('if' _disj 'else' expr)? | lambda
lambda = 'lambda' _lparams? ':' expr
_lparams = (_lpos (',' _lrest)? | _lrest) ','?
_ld = ID '=' expr
_lpos = ID (',' ID)* (',' '/' (',' ID)*)? (',' _ld)* | ID (',' ID)* (',' _ld)+ ',' '/' (',' _ld)* | _ld (',' _ld)* (',' '/' (',' _ld)*)?
_lrest = ('*' ID (',' (ID | _ld))* | '*' (',' (ID | _ld))+) (',' '**' ID)? | '**' ID
_disj = operand (_op operand)*
_op = 'and' | 'or' | '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
operand = ('not' | '-' | '+' | '~~' | 'await')* _atom _tail*
_tail = '.' ID | '[' _subs ']' | args
_subs = _sub (',' _sub)* ','?
_sub = '*'? named | expr? ':' expr? (':' expr?)?
args = '(' (_alist ','? | named comp)? ')'
_pa = named | '*' expr
_kw = ID '=' expr
_alist = _pa (',' _pa)* (',' _kw (',' (_kw | '*' expr))*)? (',' '**' expr (',' (_kw | '**' expr))*)? | _kw (',' (_kw | '*' expr))* (',' '**' expr (',' (_kw | '**' expr))*)? | '**' expr (',' (_kw | '**' expr))*
comp = ('async'? 'for' _tlist 'in' _disj ('if' (_disj | (ID ':=' _disj) | lambda))*)+
_atom = ID | 'NUM' | strings | 'None' | 'True' | 'False' | '...' | '(' (yield | ('*'? named) (',' '*'? named)* ','? | named comp)? ')' | '[' (('*'? named) (',' '*'? named)* ','? | named comp)? ']' | '{' ((_kv (',' _kv)* ','?) | expr ':' expr comp | ('*'? named) (',' '*'? named)* ','? | named comp)? '}'
_kv = expr ':' expr | '**' operand
strings = 'STR'+ | 'BYTES'+
"""


def _fill(text: str, fill: dict[str, str]) -> str:
    return re.sub(r"\b(" + "|".join(sorted(fill, key=len, reverse=True)) + r")\b", lambda m: fill[m[1]], text).replace("'~~'", "'~'")


@lru_cache(None)
def grammar(language: str) -> Grammar:
    if language == "javascript":
        return Grammar(_fill(_JS, _JS_FILL), ["script", "module"], tuple(_SOFT), tuple(JS_WORDS))
    if language == "typescript":
        return Grammar(_fill(_JS, _TS_FILL) + _TS, ["script", "module"], tuple(_SOFT), tuple(JS_WORDS))
    if language == "java":
        return Grammar(_JAVA.replace("'~~'", "'~'"), ["unit"], tuple(JAVA_SOFT), tuple(JAVA_WORDS))
    if language == "go":
        return Grammar(_GO.replace("'~~'", "'~'"), ["unit"], (), tuple(GO_WORDS))
    if language == "rust":
        return Grammar(_RUST.replace("'~~'", "'~'"), ["unit"], tuple(RUST_SOFT), tuple(RUST_WORDS))
    return Grammar(_PY.replace("'~~'", "'~'"), ["file"], tuple(PY_SOFT), tuple(PY_WORDS))


@lru_cache(None)
def _py_field() -> Grammar:
    return Grammar(_PY.replace("'~~'", "'~'"), ["field"], tuple(PY_SOFT), tuple(PY_WORDS))


def lex(src: str, language: str, comments: list | None = None) -> list:
    """Tokens of a source; raises LexError where none can be read."""
    if language in ("javascript", "typescript"):
        return lex_js(src, JS_WORDS, comments)
    if language == "java":
        return lex_c(src, JAVA_RE, JAVA_WORDS, comments, soft=JAVA_SOFT)
    if language == "go":
        return lex_c(src, GO_RE, GO_WORDS, comments, go=True)
    if language == "rust":
        return lex_c(src, RUST_RE, RUST_WORDS, comments, rust=True, soft=RUST_SOFT)
    return lex_py(src, PY_WORDS, comments, soft=PY_SOFT)


_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_NO_TARGET = frozenset("NUM STR REGEX TPLFULL TPLTAIL null true false this ++ --".split())


def _bad_target(toks: list) -> bool:
    """Whether something that can't be assigned to stands before an assignment
    sign. Names of class fields may be literals, so files with classes are left
    to the grammar."""
    if any(t[0] == "class" for t in toks):
        return False
    return any(b[0] in _ASSIGN and a[0] in _NO_TARGET for a, b in zip(toks, toks[1:]))


def read(src: str, language: str, comments: list | None = None, fields: list | None = None) -> list:
    """Tokens of a source; ``fields`` gets the expressions inside f-strings."""
    if language == "python":
        return lex_py(src, PY_WORDS, comments, soft=PY_SOFT, fields=fields)
    return lex(src, language, comments)


def accepts(src: str, language: str, toks: list, fields: list[tuple[int, int]]) -> bool:
    """Whether some dialect of the language accepts the tokens of a source."""
    if language == "javascript" and _bad_target(toks):
        return False
    g = grammar(language)
    if language != "python":
        return g.accepts(g.encode([(t[0], t[1]) for t in toks]))
    if not g.accepts(g.encode([(t[0], 0) for t in toks])):
        return False
    for a, b in fields:
        try:
            sub = lex_py(src[a:b].strip(), PY_WORDS, soft=PY_SOFT, expression=True)
        except LexError:
            return False
        if not _py_field().accepts(_py_field().encode([(t[0], 0) for t in sub])):
            return False
    return True


def parses(src: str, language: str) -> bool:
    """Whether some dialect of the language accepts the source."""
    src = src.removeprefix("﻿")
    fields: list[tuple[int, int]] = []
    try:
        toks = read(src, language, None, fields)
    except LexError:
        return False
    return accepts(src, language, toks, fields)
