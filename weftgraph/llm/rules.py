"""Grammar rules per language, over the token classes of the lexers. Recursion goes through bracket groups only,
and in Python through the indented lines of suites.

They accept somewhat more than the languages: precedence, types and names do not matter, and in types what stands between
angle brackets is a free mix of type words. What a valid file of the language can hold is accepted.
"""

from __future__ import annotations

_JAVA = """
Top := Annot* ('package' Q ';')? (Import | ';')* (TypeDecl | ';')*
Import := 'import' 'static'? ID ('.' (ID | STAR))* ';'
Q := ID ('.' ID)*
Annot := '@' Q ('(' AnnArgs? ')')?
AnnArgs := AnnArg (',' AnnArg)*
AnnArg := (ID '=')? (E | Annot | '{' ((E | Annot) (',' (E | Annot))* ','?)? '}')
Mod := Annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | ID
TypeDecl := Mod* ('class' | 'interface' | 'enum' | '@' 'interface') ID TArgs? (('extends' | 'implements' | ID) Type (',' Type)*)* '{' ClassBody '}' | Mod* ID ID TArgs? '(' Params? ')' ('implements' Type (',' Type)*)? '{' ClassBody '}'
Prim := 'boolean' | 'byte' | 'char' | 'double' | 'float' | 'int' | 'long' | 'short' | 'void'
TArgs := '<' TMix* '>'
TMix := ID | Prim | '.' | ',' | '?' | '<' | '>' | 'extends' | 'super' | AMP | '[' ']' | Annot
Type := Annot* (Prim | ID TArgs? ('.' ID TArgs?)*) (Annot* '[' ']')*
Params := Param (',' Param)*
Param := ('final' | Annot)* Type DOTS? ID ('[' ']')*
ClassBody := EnumItems? Member*
EnumItems := Annot* ID ('(' Args? ')')? ('{' ClassBody '}')? (',' Annot* ID ('(' Args? ')')? ('{' ClassBody '}')?)* ','? ';'?
Member := ';' | 'static'? '{' Block '}' | TypeDecl | Mod* TArgs? Type? ID '(' Params? ')' ('[' ']')* ('throws' Type (',' Type)*)? ('{' Block '}' | ('default' E)? ';') | Mod* Type Decls ';' | Mod* ID '{' Block '}'
Decls := Decl (',' Decl)*
Decl := ID ('[' ']')* ('=' Init)?
Init := E | '{' (Init0 (',' Init0)*)? ','? '}'
Init0 := E | '{' (E (',' E)*)? ','? '}'
Args := E (',' E)*
Un := NOT | PM | INC | '(' Type (AMP Type)* ')'
Prim0 := ID | NUM | STR | 'super' | '(' E ')' | '(' LambdaParams? ')' | 'new' Annot* (Type ('(' Args? ')' ('{' ClassBody '}')? | '{' (Init0 (',' Init0)*)? ','? '}')? | NewBase ('[' E? ']')+ ('{' (Init0 (',' Init0)*)? ','? '}')?) | Prim ('[' ']')* | 'switch' '(' E ')' '{' SwitchBody '}'
NewBase := Prim | Q
LambdaParams := ID (',' ID)* | Params
Post := '.' (TArgs? ID | 'class' | 'new' ID TArgs? '(' Args? ')' | 'super') | '(' Args? ')' | '[' E? ']' | INC | SCOPE (ID | 'new') | TArgs SCOPE (ID | 'new')
Bin := BIN | STAR | AMP | PM | '<' | '>' | '>' '=' | '?' | ':' | '=' | ASG
Rest := Bin Un* Prim0 Post* | 'instanceof' 'final'? Type ID? | ARROW (Un* Prim0 Post* | '{' Block '}')
E := Un* Prim0 Post* Rest*
Block := Stmt*
SwitchBody := Stmt*
Pre := 'if' '(' E ')' | 'else' | 'for' '(' For ')' | 'while' '(' E ')' | ID ':' | 'do' | 'synchronized' '(' E ')' | 'case' (Type ID | E (',' E)*) (':' | ARROW) | 'default' (':' | ARROW)
For := (LocalDecl | E (',' E)*)? ';' E? ';' (E (',' E)*)? | ('final' | Annot)* Type ID ':' E
LocalDecl := ('final' | Annot)* Type Decls
Catch := 'catch' '(' ('final' | Annot)* Type (BIN Type)* ID ')' '{' Block '}'
Try := 'try' '{' Block '}' (Catch+ ('finally' '{' Block '}')? | 'finally' '{' Block '}') | 'try' '(' (LocalDecl | E) (';' (LocalDecl | E))* ';'? ')' '{' Block '}' Catch* ('finally' '{' Block '}')?
Basic := ';' | '{' Block '}' | Try | 'switch' '(' E ')' '{' SwitchBody '}' | ('return' | 'throw' | 'break' | 'continue') E? ';' | 'assert' E ';' | LocalDecl ';' | E ';' | TypeDecl
Stmt := Pre* Basic
"""

_GO = """
Top := 'package' ID ';' ('import' (ImpSpec | '(' (ImpSpec ';')* ImpSpec? ')') ';')* ((Decl | Func) ';')*
ImpSpec := (ID | '.')? STR
Decl := 'const' (Spec | '(' (Spec ';')* Spec? ')') | 'var' (Spec | '(' (Spec ';')* Spec? ')') | 'type' (TSpec | '(' (TSpec ';')* TSpec? ')')
Spec := ID (',' ID)* Type? ('=' Es)?
TSpec := ID ('[' TParams ']')? '='? Type
TParams := ID (',' ID)* TCon (',' ID (',' ID)* TCon)*
TCon := (PM | NOT)? Type (BIN NOT? Type)*
Func := 'func' ('(' ID? Type ')')? ID ('[' TParams ']')? Sig ('{' Block '}')?
Sig := '(' Params? ')' (Type | '(' Params? ')')?
Params := Param (',' Param)* ','?
Param := ID? DOTS? Type
TPre := PM | '[' (NUM | ID | DOTS | E)? ']' | 'map' '[' Type ']' | 'chan' CHAN? | CHAN 'chan'
Type := TPre* Base
Base := ID ('.' ID)? ('[' Type (',' Type)* ']')? | 'func' '(' Params? ')' Base1? | 'struct' '{' Fields '}' | 'interface' '{' IFields '}' | '(' Type ')'
Base1 := TPre* (ID ('.' ID)? | '(' Params? ')')
Fields := (Field ';')* Field?
Field := (ID (',' ID)* Type | PM? ID ('.' ID)? ('[' Type (',' Type)* ']')?) STR?
IFields := ((ID Sig0 | TCon) ';')* (ID Sig0 | TCon)?
Sig0 := '(' Params? ')' Base1?
Es := E (',' E)*
Un := PM | NOT | CHAN
Lit := '{' Elems? '}'
Elems := Elem (',' Elem)* ','?
Elem := (E | Lit) (':' (E | Lit))?
Prim0 := ID | NUM | STR | '(' E ')' | 'func' Sig1 '{' Block '}' | TPre+ Base2 Lit? | 'struct' '{' Fields '}' Lit? | 'interface' '{' IFields '}'
Sig1 := '(' Params? ')' Base1?
Base2 := ID ('.' ID)? | 'struct' '{' Fields '}' | 'interface' '{' IFields '}' | 'func' '(' Params? ')' Base1?
Post := '.' ID | '.' '(' (Type | 'type') ')' | '(' (Arg (',' Arg)* DOTS? ','?)? ')' | '[' E? (':' E?)* ']' | '[' Type (',' Type)+ ']' | Lit
Arg := E | Type
Bin := BIN | PM | '<' | '>' | '>' '=' | CHAN
E := Un* Prim0 Post* (Bin Un* Prim0 Post*)*
Simple := Es | Es INC | Es ('=' | ASG | WALRUS) Es | Es ('=' | WALRUS) 'range' E
Block := (Stmt ';')* Stmt?
If := 'if' (Simple? ';')? Simple '{' Block '}'
Stmt := Pre* Basic?
Pre := ID ':' | 'case' Cases ':' | 'default' ':'
Cases := Simple | Type (',' Type)* | Es
Basic := Simple | Decl | '{' Block '}' | If ('else' If)* ('else' '{' Block '}')? | 'for' (Simple | Simple? ';' Simple? ';' Simple? | 'range' E)? '{' Block '}' | 'switch' (Simple? ';')? Simple? '{' Block '}' | 'select' '{' Block '}' | ('return' Es? | 'break' ID? | 'continue' ID? | 'fallthrough' | 'goto' ID | 'go' E | 'defer' E)
"""

_RUST = """
Top := Inner* Item*
Inner := '#' NOT '[' Meta ']'
Attr := '#' '[' Meta ']'
Meta := TMix*
Mix := ID | NUM | STR | 'L' | ',' | ';' | ':' | '.' | '?' | '=' | '<' | '>' | '@' | '#' | BIN | BAR | STAR | PM | NOT | ASG | ARROW | FAT | SCOPE | RANGE | '(' TMix* ')' | '[' TMix* ']' | '{' TMix* '}' | KW
TMix := Mix
KW := 'as' | 'async' | 'await' | 'break' | 'const' | 'continue' | 'dyn' | 'else' | 'enum' | 'extern' | 'fn' | 'for' | 'if' | 'impl' | 'in' | 'let' | 'loop' | 'match' | 'mod' | 'move' | 'mut' | 'pub' | 'ref' | 'return' | 'static' | 'struct' | 'trait' | 'type' | 'unsafe' | 'use' | 'where' | 'while'
Vis := 'pub' ('(' ('in'? Path) ')')?
Path := SCOPE? ID (SCOPE ID)*
Item := Attr* Vis? (Use | Mod | Fn | Struct | Enum | Impl | Trait | Const | TypeA | Macro | Extern)
Use := 'use' UseTree ';'
UseTree := (SCOPE? (ID SCOPE)*) (ID ('as' ID)? | STAR | '{' (UseT (',' UseT)* ','?)? '}')
UseT := (SCOPE? (ID SCOPE)*) (ID ('as' ID)? | STAR | '{' (UseT1 (',' UseT1)* ','?)? '}')
UseT1 := (SCOPE? (ID SCOPE)*) (ID ('as' ID)? | STAR)
Mod := 'mod' ID (';' | '{' Inner* Items '}')
Items := Item*
Extern := 'extern' 'ID'? ID ('as' ID)? ';' | 'unsafe'? 'extern' STR? '{' Items '}'
Gen := '<' GMix* '>'
GMix := ID | 'L' | NUM | ',' | ':' | '=' | '<' | '>' | SCOPE | PM | BIN | STAR | 'dyn' | 'mut' | 'const' | 'impl' | 'for' | '?' | ARROW | NOT | 'fn' | 'as' | '(' (Type (',' Type)* ','?)? ')' | '[' Type (';' E)? ']'
Where := 'where' (WMix)*
WMix := ID | 'L' | ',' | ':' | BIN | '?' | SCOPE | PM | 'dyn' | 'mut' | 'for' | '=' | Gen | ARROW | '(' (Type (',' Type)* ','?)? ')' | '[' Type (';' E)? ']'
TPath := SCOPE? ID Gen? (SCOPE (ID Gen? | Gen))* ('(' (Type (',' Type)* ','?)? ')')?
TPre := PM 'L'? 'mut'? | BIN 'L'? 'mut'? | STAR ('const' | 'mut') | 'dyn' | 'impl' | 'unsafe' | 'for' Gen | '?' | ('extern' STR?)
Bound := 'L' | '?'? TPath
Type0 := TPath (ARROW TPre* TBase)? | '(' (Type (',' Type)* ','?)? ')' | '[' Type (';' E)? ']' | NOT | 'L' | 'fn' '(' (Type2 (',' Type2)* ','?)? ')' (ARROW TPre* TBase)? | Gen SCOPE ID Gen?
Type2 := (ID ':')? Type
TBase := TPath | '(' (Type (',' Type)* ','?)? ')' | '[' Type (';' E)? ']' | NOT
Type := TPre* Type0 (BIN TPre* Bound)*
Fn := ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID Gen? '(' FnParams? ')' (ARROW Type)? Where? ('{' Block '}' | ';')
FnParams := FnParam (',' FnParam)* ','?
FnParam := Attr* (Self | Pat ':' Type | DOTS0)
DOTS0 := RANGE
Self := (PM 'L'?)? 'mut'? ID (':' Type)?
Struct := 'struct' ID Gen? (Where? '{' SFields? '}' | '(' TFields? ')' Where? ';' | ';')
SFields := SField (',' SField)* ','?
SField := Attr* Vis? ID ':' Type
TFields := Attr* Vis? Type (',' Attr* Vis? Type)* ','?
Enum := 'enum' ID Gen? Where? '{' (Variant (',' Variant)* ','?)? '}'
Variant := Attr* ID ('{' SFields? '}' | '(' TFields? ')')? ('=' E)?
Impl := 'unsafe'? 'impl' Gen? (NOT? Type 'for')? Type Where? '{' Inner* Items '}'
Trait := 'unsafe'? 'trait' ID Gen? (':' TPre* Bound (BIN TPre* Bound)*)? Where? '{' Items '}'
Const := ('const' | 'static' 'mut'?) ID ':' Type ('=' E)? ';'
TypeA := 'type' ID Gen? (':' Bound (BIN Bound)*)? ('=' Type)? Where? ';'
Macro := Path NOT ID? ('(' TMix* ')' ';' | '[' TMix* ']' ';' | '{' TMix* '}')
Pat0 := (PM | BIN | 'ref' | 'mut' | 'L')* (ID | NUM | STR | PM NUM | TPath ('{' PFields? '}' | '(' Pats? ')')? | '(' Pats? ')' | '[' Pats? ']' | RANGE) ('@' Pat1)? (RANGE (ID | NUM | STR | PM NUM)?)?
Pat1 := (PM | BIN | 'ref' | 'mut')* (ID | NUM | STR | PM NUM | TPath ('{' PFields? '}' | '(' Pats? ')')? | '(' Pats? ')' | '[' Pats? ']' | RANGE) (RANGE (ID | NUM | STR)?)?
Pat := BAR? Pat0 (BAR Pat0)*
Pats := Pat (',' Pat)* ','?
PFields := PField (',' PField)* ','?
PField := Attr* ('ref' | 'mut')* ID (':' Pat)? | RANGE
Un := NOT | PM 'mut'? | BIN 'mut'? | STAR
LamParams := LamParam (',' LamParam)* ','?
LamParam := Pat1 (':' LType)?
LType := (PM 'L'? 'mut'? | 'dyn')* (TPath | '(' (Type (',' Type)* ','?)? ')' | '[' Type (';' E)? ']')
Lam := 'move'? BAR (LamParams BAR)? (ARROW LType)?
Cond := 'let' Pat '=' Simple0
Simple0 := Un* (ID | NUM | STR | '(' (E (',' E)* ','?)? ')' | '[' (E (',' E)* ','?)? ']') Post*
Prim0 := ID | NUM | STR | Gen SCOPE ID | '(' (E (',' E)* ','?)? ')' | '[' (E (',' E)* ','? | E ';' E)? ']' | 'unsafe'? '{' Block '}' | 'async' 'move'? '{' Block '}' | 'const' '{' Block '}' | If | Match | Loop | 'return' | 'break' 'L'? | 'continue' 'L'? | 'let' Pat '=' | RANGE | Lam
Post := '.' (ID | NUM | 'await') | SCOPE (ID | Gen) | '(' (E (',' E)* ','?)? ')' | '[' E ']' | '?' | NOT ('(' TMix* ')' | '[' TMix* ']' | '{' TMix* '}') | '{' EFields? '}' | 'as' Type
EFields := EField (',' EField)* (',' RANGE E?)? ','? | RANGE E?
EField := Attr* (ID | NUM) (':' E)?
Bin := BIN | BAR | PM | STAR | '<' | '>' | '>' '=' | RANGE | '=' | ASG
E := Attr* (Un | Lam | 'return' | 'break' 'L'? | RANGE | 'let' Pat '=')* Prim0 Post* (Bin (Un | Lam | 'return' | 'let' Pat '=')* Prim0 Post* | RANGE)*
If := 'if' EI '{' Block '}' ('else' 'if' EI '{' Block '}')* ('else' '{' Block '}')?
EI := (Un | 'let' Pat '=')* PrimI PostI* (Bin (Un | 'let' Pat '=')* PrimI PostI* | RANGE)*
PrimI := ID | NUM | STR | '(' (E (',' E)* ','?)? ')' | '[' (E (',' E)* ','? | E ';' E)? ']' | Lam | 'unsafe'? '{' Block '}' | RANGE
PostI := '.' (ID | NUM | 'await') | SCOPE (ID | Gen) | '(' (E (',' E)* ','?)? ')' | '[' E ']' | '?' | NOT ('(' TMix* ')' | '[' TMix* ']') | 'as' Type
Match := 'match' EI '{' Inner* Arms '}'
Arms := (Arm)*
Arm := Attr* Pat ('if' E)? FAT E ','?
Loop := ('L' ':')? ('loop' | 'while' EI | 'for' Pat 'in' EI) '{' Block '}'
Block := Inner* Stmt* E?
Stmt := ';' | Item | 'let' Pat (':' Type)? ('=' E ('else' '{' Block '}')?)? ';' | E ';' | Attr* (If | Match | Loop | 'unsafe'? '{' Block '}') | Macro
"""

_JSBASE = """
Top := TopStmt* Last?
Import := 'import' (STR | (ID (',' (Star | Named))? | Star | Named | TypeImp) From ';'? | STR ';'?) | 'import' STR ';'?
Star := BIN ID ID
Named := '{' (ImpName (',' ImpName)* ','?)? '}'
ImpName := (Name) (ID Name)?
From := ID STR
Name := ID | 'async' | 'of' | 'default' | 'new' | 'delete' | 'class' | 'function' | 'in' | 'for' | 'if' | 'return' | 'static' | 'catch' | 'finally' | 'import' | 'export' | 'switch' | 'case' | 'do' | 'while' | 'with' | 'try' | 'throw' | 'typeof' | 'void' | 'yield' | 'await' | 'instanceof' | 'extends' | 'break' | 'continue' | 'const' | 'let' | 'var' | 'else' | 'debugger' KWX
Export := 'export' ('default' (FuncDecl | ClassDecl | E ';'? | ExpX) | Named (From)? ';'? | BIN (ID ID)? From ';'? | ID ID From ';'? | Decl ExpT)
Decl := FuncDecl | ClassDecl | VarDecl ';'?
TopStmt := Import | Export | Stmt
FuncDecl := 'async'? 'function' BIN? ID? TPARAMS '(' Params? ')' RET ('{' Block '}' FEND)
Params := Param (',' Param)* ','?
Param := PMOD* DOTS? (Bind | ID) OPTQ TANN ('=' E)?
Bind := '{' (BindP (',' BindP)* ','?)? '}' | '[' ((BindE? ',')* BindE?) ']'
BindP := DOTS ID | PName (':' (ID | Bind0))? ('=' E)?
Bind0 := '{' (BindQ (',' BindQ)* ','?)? '}' | '[' (ID? ',')* ID? ']'
BindQ := DOTS ID | PName (':' ID)? ('=' E)?
BindE := DOTS? (ID | Bind0) ('=' E)?
ClassDecl := CMOD 'class' ID? TPARAMS ('extends' Heir TARGS)? IMPL '{' Members '}'
Heir := (ID | '(' E ')') ('.' ID | '(' Args? ')')*
Members := (Member)*
Member := ';' | 'static' '{' Block '}' | Deco* MMOD* ('async')? BIN? PName OPTQ TPARAMS '(' Params? ')' RET ('{' Block '}' MEND) | Deco* MMOD* PName OPTQ TANN ('=' E)? ';' MEXTRA
Deco := '@' ID ('.' ID)* ('(' Args? ')')?
PName := Name | STR | NUM | '[' E ']'
VarDecl := ('const' | 'let' | 'var') VarD (',' VarD)*
VarD := (ID | Bind) OPTB TANN ('=' E)?
Args := Arg (',' Arg)* ','?
Arg := DOTS? E
Un := NOT | PM | INC | 'typeof' | 'void' | 'delete' | 'await' | 'yield' BIN? | 'new' | 'async' UNX
Fn := 'async'? 'function' BIN? ID? TPARAMS '(' Params? ')' RET '{' Block '}'
Prim0 := ID | NUM | STR | 'of' | 'async' | '(' (E (',' E)*) ')' | '(' Params? ')' RET FAT0 | '[' ((Arg? ',')* Arg?) ']' | '{' (Prop (',' Prop)* ','?)? '}' | Fn | 'class' ID? ('extends' Heir TARGS)? IMPL '{' Members '}' | 'super' | 'import' | 'new' '.' ID
Prop := DOTS E | PName (':' E)? ('=' E)? | ('async')? BIN? (ID)? PName TPARAMS '(' Params? ')' RET '{' Block '}'
FAT0 := FAT ('{' Block '}' | Un* Prim1 Post*)
Prim1 := ID | NUM | STR | '(' (E (',' E)*) ')' | '(' Params? ')' FAT | '[' ((Arg? ',')* Arg?) ']' | Fn | 'of'
Post := '.' Name | OPT (Name | '(' Args? ')' | '[' E ']') | '(' Args? ')' | '[' E (',' E)* ']' | INC | STR POSTX
Bin := BIN | PM | '<' | '>' | '>' '=' | '=' | ASG | 'in' | 'instanceof' BINX
Opd := Un* Prim0 Post*
FatB := FAT ('{' Block '}' | Opd)
Tern0 := '?' Opd (Bin Opd | FatB)* ':' Opd
Tern := '?' Opd (Bin Opd | FatB | Tern0)* ':' Opd
E := Opd (Bin Opd | Tern | FAT ('{' Block '}' | Un* Prim0 Post*) ETYPE)*
Es := E (',' E)*
Block := Stmt* Last?
Last := Pre* (Es | VarDecl | ('return' | 'throw') Es? | 'break' ID? | 'continue' ID?)
Pre := 'if' '(' Es ')' | 'else' | 'for' 'await'? '(' For ')' | 'while' '(' Es ')' | 'do' | ID ':' | 'case' Es ':' | 'default' ':' | 'with' '(' E ')'
For := (VarDecl | Es)? ';' Es? ';' Es? | (('const' | 'let' | 'var') (ID | Bind) | E) ('of' | 'in') Es
Try := 'try' '{' Block '}' ('catch' ('(' (ID TANN | Bind) ')')? '{' Block '}' ('finally' '{' Block '}')? | 'finally' '{' Block '}')
Basic := ';' | '{' Block '}' | VarDecl ';' | FuncDecl | Deco* ClassDecl | Try | 'switch' '(' Es ')' '{' Block '}' | ('return' | 'throw') Es? ';' | 'break' ID? ';' | 'continue' ID? ';' | 'debugger' ';' | Es ';' STMTX
Stmt := Pre* Basic
"""


def _fill(**parts: str) -> str:
    out = _JSBASE
    for name in sorted(parts, key=len, reverse=True):
        out = out.replace(name, parts[name])
    return out


_JS = _fill(KWX="", ExpX="FuncDecl", ExpT="", TypeImp="Named", TPARAMS="", RET="", FEND="", PMOD="Deco", OPTQ="", OPTB="", TANN="", CMOD="", TARGS="", IMPL="", MMOD="'static' | Deco | ID | 'async'", MEND="", MEXTRA="",
            UNX="", POSTX="", BINX="", ETYPE="", STMTX="").replace("MMOD*", "").replace("Deco* 'static' | Deco | ID | 'async'*", "Deco* ('static' | Deco | ID | 'async')*")
_TS = _fill(
    KWX="| 'abstract' | 'declare' | 'enum' | 'implements' | 'interface' | 'private' | 'protected' | 'public' | 'readonly'", ExpX="Inter | 'abstract' ClassDecl", ExpT="| Inter | Enum | Alias | Space | 'declare' (Decl | Space | Alias | Enum | Inter)",
    TypeImp="ID (Named | ID)", TPARAMS="TArgs?", RET="(':' Type)?", FEND="| ';'", PMOD="('public' | 'private' | 'protected' | 'readonly' | Deco)", OPTQ="'?'?", OPTB="NOT?", TANN="(':' Type)?", CMOD="'abstract'?", TARGS="TArgs?",
    IMPL="('implements' Type (',' Type)*)?", MMOD="('static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | Deco | ID | 'async')", MEND="| ';'", MEXTRA="| '[' ID ':' Type ']' ':' Type ';' | '@' ID",
    UNX="| TArgs", POSTX="| NOT | TArgs", BINX="| BAR", ETYPE="| ('as' | ID) Type", STMTX="| Inter | Enum | Alias | Space | 'declare' (Decl | Space | Alias | Enum | Inter) | 'abstract' ClassDecl",
).replace("('as' | ID) Type", "ID Type") + """
TArgs := '<' TMix* '>'
TMix := ID | STR | NUM | ',' | '.' | '?' | ':' | '=' | '<' | '>' | BAR | FAT | 'extends' | 'void' | 'typeof' | 'in' | 'new' | 'readonly' | PM | '[' TM* ']' | '(' (Params | Type)? ')' | '{' TBody '}'
TM := TMix
TPre := 'typeof' | 'readonly' | ID | PM | 'new' | 'abstract' | BAR
TAtom := ID TArgs? ('.' ID TArgs?)* | 'void' | STR | NUM | '{' TBody '}' | '[' ((ID '?'? ':')? DOTS? Type (',' (ID '?'? ':')? DOTS? Type)* ','?)? ']' | '(' Type ')' | 'import' '(' STR ')' | TArgs? '(' Params? ')' FAT
TPost := '[' Type? ']'
Type := TPre* TAtom TPost* ((BAR | 'extends' | '?' | ':' | FAT | ID | 'in') TPre* TAtom TPost*)*
TBody := (TMem (';' | ','))* TMem?
TMem := 'readonly'? PName '?'? (':' Type)? | PName? '?'? TArgs? '(' Params? ')' (':' Type)? | 'new' '(' Params? ')' (':' Type)? | PM? 'readonly'? '[' ID (':' | 'in') Type (ID Type)? ']' PM? '?'? (':' Type)? | ID PName '(' Params? ')' (':' Type)?
Inter := 'interface' ID TArgs? ('extends' Type (',' Type)*)? '{' TBody '}'
Enum := 'const'? 'enum' ID '{' ((ID | STR) ('=' E)? (',' (ID | STR) ('=' E)?)* ','?)? '}'
Alias := ID ID TArgs? '=' BAR? Type ';'?
Space := ID (ID | STR) ('.' ID)* '{' TopS '}' | ID '{' TopS '}'
TopS := TopStmt* Last?
"""
_JS = _JS

_C = """
Top := (Ext | ';')*
Attr := ID '(' Args? ')'
Spec := 'auto' | 'char' | 'const' | 'double' | 'enum' ID | 'extern' STR? | 'float' | 'inline' | 'int' | 'long' | 'register' | RESTRICT 'short' | 'signed' | 'static' | 'struct' ID | 'union' ID | 'typedef' | 'unsigned' | 'void' | 'volatile' SPECX
Agg := ('struct' | 'union' AGGX) ATTRX ID? FINX BASES '{' Fields '}' | 'enum' ENUMX ID? (':' Spec0)? '{' (Enumr (',' Enumr)* ','?)? '}'
Spec0 := Spec+ | Spec* QID Spec*
Enumr := ID ('=' E)?
QID := ID QIDX
TypeS := Spec+ | Spec* QID Spec* | Spec* Agg Spec*
Ptr := STAR | 'const' | 'volatile' RESTP
Ds := Ptr* (DName | '(' Ds1 ')') DPost*
Ds1 := Ptr* QID0? DPost* | Ptr* '(' Ptr* ID? DPost* ')' DPost*
QID0 := ID SCOPEX
DName := QID OPERX
DPost := '[' ('static'? E)? ']' | '(' Params? ')' FQUALS
Decl := Ds (':' E)? ('=' Init)? INITX
Init := E | '{' (Inits)? '}'
Inits := Desig? Init1 (',' Desig? Init1)* ','?
Init1 := E | '{' (Init2 (',' Init2)* ','?)? '}'
Init2 := Desig? (E | '{' (E (',' E)* ','?)? '}')
Desig := ('.' ID | '[' E ']')+ '='
Params := Param (',' Param)* (',' DOTS)? | DOTS
Param := TypeS (Ptr* ID? DPost* | Ptr* '(' Ptr* ID? DPost* ')' DPost*) PDEF
DeclS := TypeS (Decl (',' Decl)*)? ';'
Fields := (Field | ';')*
Field := DeclS | TypeS ':' E ';' FIELDX
Ext := TypeS Ds CTORI '{' Block '}' | DeclS | Attr ';'? EXTX
Type := TypeS (Ptr)* ('(' Ptr* ')' '(' Params? ')' | '[' E? ']')*
Args := Arg (',' Arg)*
Arg := E | Type ARGX
Un := NOT | PM | INC | STAR | 'sizeof' | '(' Type ')' UNX
Prim0 := QID | NUM | STR | '(' E (',' E)* ')' | '(' Type ')' '{' Inits? '}' | 'sizeof' '(' Type ')' | '(' '{' Block '}' ')' PRIMX
Post := '.' ID | ARROW ID | '(' Args? ')' | '[' E ']' | INC | STR POSTX
Bin := BIN | STAR | PM | '<' | '>' | '>' '=' | '?' | ':' | '=' | ASG BINX
E := Un* Prim0 Post* (Bin Un* Prim0 Post*)*
Es := E (',' E)*
Block := Stmt*
Pre := 'if' CEX '(' Cond ')' | 'else' | 'for' '(' For ')' | 'while' '(' Cond ')' | 'do' | ID ':' | 'case' E (DOTS E)? ':' | 'default' ':' | 'switch' '(' Cond ')'
Cond := Es CONDX
For := (DeclS | Es? ';') Es? ';' Es? FORX
Basic := ';' | '{' Block '}' | ('return' Es? | 'break' | 'continue' | 'goto' ID) ';' | DeclS | Es ';' STMTX
Stmt := Pre* Basic
"""


def _fill_c(**parts: str) -> str:
    out = _C
    for name in sorted(parts, key=len, reverse=True):
        out = out.replace(name, parts[name])
    return out


_CC = _fill_c(RESTRICT="'restrict' | ", RESTP="| 'restrict'", SPECX="", AGGX="", ATTRX="", FINX="", BASES="", ENUMX="", QIDX="", OPERX="", FQUALS="", INITX="", PDEF="", FIELDX="", CTORI="", EXTX="", ARGX="", UNX="", PRIMX="", POSTX="",
              BINX="", CEX="", CONDX="", FORX="", STMTX="", SCOPEX="")
_CPP = _fill_c(
    RESTRICT="", RESTP="", SPECX="| 'bool' | 'constexpr' | 'explicit' | 'friend' | 'mutable' | 'virtual' | 'typename' | 'class' ID | 'decltype' '(' E ')' | 'alignas' '(' E ')' | AttrX", AGGX="| 'class'", ATTRX="AttrX*", FINX="TArgs? ID?",
    BASES="(':' Base (',' Base)*)?", ENUMX="('class' | 'struct')?", QIDX="TArgs? (SCOPE 'template'? (NOT? ID TArgs?))*", OPERX="| (ID TArgs? SCOPE)* 'operator' (BIN | PM | STAR | NOT | INC | ASG | '=' | '<' | '>' | '(' ')' | '[' ']' | ARROW | TypeS Ptr* | 'new' | 'delete' | ',') | NOT ID | (ID TArgs? SCOPE)+ (NOT? ID | STAR)",
    FQUALS="('const' | 'noexcept' ('(' E ')')? | 'override' | ID | STAR | 'volatile' | ARROW Type | 'throw' '(' ')')* ('=' ('default' | 'delete' | NUM))?", INITX="| Ds '{' Inits? '}' | Ds '(' Args? ')'", PDEF="DOTS? ID? ('=' Init)?",
    FIELDX="| ('public' | 'private' | 'protected') ID? ':' | Ext0 | Using | TypeS? Ds MInits '{' Block '}' | Ds ';' | 'friend' DeclS", CTORI="(':' MInit (',' MInit)*)? ('try')?", EXTX="| Ext0 | Ds MInits '{' Block '}' | Ds ';'",
    ARGX="| '{' Inits? '}' | E DOTS", UNX="| 'delete' ('[' ']')? | 'throw' | 'new' ('(' Args? ')')? | 'noexcept'", PRIMX="| Lam | Spec+ Ptr* ('(' Args? ')' | '{' Inits? '}' | '[' E ']')? | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') TArgs '(' E ')' | 'typeid' '(' Arg ')' | 'throw' | SCOPE QID | 'sizeof' DOTS '(' ID ')' | 'decltype' '(' E ')' | 'alignof' '(' Type ')' | 'operator' (BIN | PM | STAR)",
    POSTX="| '{' Inits? '}' | TArgs | DOTS | '.' 'template'? (NOT? ID TArgs?) | ARROW 'template'? (NOT? ID TArgs? | 'operator' (BIN | PM))", BINX="| '>' '>' | '.' STAR | ARROW STAR", CEX="'constexpr'?",
    CONDX="| DeclC | (DeclS | Es ';') (Es | DeclC)", FORX="| TypeS Ptr* (ID | '[' ID (',' ID)* ']') ':' (E | '{' Inits? '}')", STMTX="| 'return' '{' Inits? '}' ';' | 'try' '{' Block '}' Catch+ | Using | 'co_return' ';' | 'throw' Es? ';' | Ext0".replace("| 'co_return' ';' ", ""), SCOPEX="(SCOPE STAR? ID?)*",
) + """
AttrX := '[' '[' AMix* ']' ']'
AMix := ID | ',' | '(' Args? ')' | SCOPE | STR
TArgs := '<' TMix* '>'
TMix := ID | NUM | STR | Spec | SCOPE | ',' | STAR | '<' | '>' | DOTS | '=' | PM | NOT | BIN | '(' (Params | Args)? ')' | '[' E? ']' | '{' Inits? '}' | 'template' | 'class' | 'typename' | 'sizeof' | 'noexcept' | 'alignof' | '.' | '?' | ':'
Base := ('public' | 'private' | 'protected' | 'virtual')* QID DOTS?
MInit := QID ('(' Args? ')' | '{' Inits? '}') DOTS?
MInits := (':' MInit (',' MInit)*)?
Using := 'using' ('namespace' QID | 'typename'? QID ('=' Type)? | ID AttrX* '=' Type) ';'
Ext0 := 'template' TArgs? (ID E)? Ext1 | 'inline'? 'namespace' (ID (SCOPE ID)*)? ('{' Top0 '}' | '=' QID ';') | 'extern' STR '{' Top0 '}' | Using | 'static_assert0'
Ext1 := TypeS Ds MInits '{' Block '}' | DeclS | Ds MInits '{' Block '}' | Ds ';' | Using
Top0 := (Ext | ';')*
DeclC := TypeS Ds ('=' Init | '{' Inits? '}')
Catch := 'catch' '(' (TypeS (Ptr* ID? DPost*) | DOTS) ')' '{' Block '}'
Lam := '[' LCap* ']' TArgs? ('(' Params? ')')? ('mutable' | 'constexpr' | 'noexcept' ('(' E ')')?)* (ARROW Type)? '{' Block '}'
LCap := STAR | '=' | ID | ',' | DOTS | Prim9
Prim9 := NUM | STR | '(' Args? ')'
"""
_CPP = _CPP.replace(" | 'static_assert0'", "").replace("RESTRICT ", "")
_CC = _CC.replace("RESTRICT ", "")

_PYTHON = """
Top := (Line | NEWLINE)*
Line := Stmt NEWLINE | Comp
Suite := Stmt NEWLINE | NEWLINE 'I' Line+ 'D'
Stmt := Small (';' Small)* ';'?
Small := Es (('=' (Es | Yield))+ | ASG (Es | Yield) | ':' E ('=' (Es | Yield))?)? | Yield | 'pass' | 'break' | 'continue' | 'return' Es? | 'raise' (E ('from' E)?)? | ('global' | 'nonlocal') ID (',' ID)* | 'del' Es | 'assert' E (',' E)? | 'import' Q ('as' ID)? (',' Q ('as' ID)?)* | 'from' Dots? Q? 'import' (STAR | Imps | '(' Imps ','? ')') | ID ID ('[' Mix* ']')? '=' E
Dots := ('.')+
Q := ID ('.' ID)*
Imps := ID ('as' ID)? (',' ID ('as' ID)?)*
Yield := 'yield' ('from' E | Es)?
Mix := E | ',' | ':' | '=' | STAR | BIN
Comp := ('@' E NEWLINE)* ('async'? Def | Class) | 'async'? (With | For) | While | If | Try | Match
Def := 'def' ID ('[' Mix* ']')? '(' Params? ')' (ARROW E)? ':' Suite
Params := Param (',' Param)* ','?
Param := STAR | BIN ID (':' E)? | STAR ID (':' E)? | ID (':' E)? ('=' E)? | BIN
Class := 'class' ID ('[' Mix* ']')? ('(' Args? ')')? ':' Suite
Else := 'else' ':' Suite
If := 'if' E ':' Suite ('elif' E ':' Suite)* Else?
While := 'while' E ':' Suite Else?
For := 'for' Targets 'in' Es ':' Suite Else?
With := 'with' (WItem (',' WItem)* | '(' WItem (',' WItem)* ','? ')') ':' Suite
WItem := E ('as' T)?
Exc := 'except' E (',' E)* ('as' ID)? ':' Suite
Excs := Exc+ ('except' ':' Suite)? | 'except' ':' Suite | ('except' STAR E (',' E)* ('as' ID)? ':' Suite)+
Finally := 'finally' ':' Suite
Try := 'try' ':' Suite (Excs Else? Finally? | Finally)
Match := ID Es ':' NEWLINE 'I' Case+ 'D'
Case := ID Es ('as' ID)? ('if' E)? ':' Suite
Targets := T (',' T)* ','?
T := STAR? Prim0 Post*
Es := SE (',' SE)* ','?
SE := STAR? E
Un := 'not' | 'await' | PM | NOT | 'lambda' LParams? ':'
LParams := LParam (',' LParam)* ','?
LParam := STAR ID? | BIN ID | BIN | ID ('=' LE)?
LE := (PM | NOT | 'not')* Prim0 Post* (Bin (PM | NOT | 'not')* Prim0 Post*)*
Prim0 := ID | NUM | STR STR* | '(' Paren? ')' | '[' Paren? ']' | '{' Brace? '}' | DOT3
DOT3 := '.' '.' '.'
Paren := SE CompFor | SE (',' SE)* ','? | Yield
Brace := Item (',' Item)* ','? | SE (':' E)? CompFor
Item := BIN E | SE (':' E)?
CompFor := ('async'? 'for' Targets 'in' E ('if' E)*)+
Post := '.' ID | '(' Args? ')' | '[' Subs ']'
Args := Arg (',' Arg)* ','? | E CompFor
Arg := (STAR | BIN)? E | ID '=' E
Subs := Sub (',' Sub)* ','?
Sub := STAR? E | E? ':' E? (':' E?)?
Bin := BIN | STAR | PM | '<' | '>' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? | 'if' | 'else' | WALRUS | '@'
E := Un* Prim0 Post* (Bin Un* Prim0 Post*)*
"""
RULES = {"java": _JAVA, "go": _GO, "rust": _RUST, "js": _JS, "ts": _TS, "c": _CC, "cpp": _CPP, "python": _PYTHON}
