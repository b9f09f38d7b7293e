"""Schemas of files, facts and issues."""

SOURCE = "package string, root string, path string, source string"

_PARAM = "struct<name:string,kind:string,annotated:boolean,default:string>"
#: Fact families of one file; each is an array, so a file is one row and its rules need no shuffle.
FAMILIES = {
    "functions": "seq:int,name:string,class_name:string,line:int,span:int,cc:int,nesting:int,nested_returns:int,has_return:boolean,"
    f"params:array<{_PARAM}>,n_decorators:int,trivial:boolean,body_hash:string,target:string,top:boolean",
    "classes": "name:string,line:int,n_methods:int,n_attrs:int,wmc:int,n_decorators:int,exempt:boolean,top:boolean,ancestors:int",
    "imports": "line:int,kind:string,module:string,name:string,bound:string,top:boolean,alias:int,final:boolean",
    "ifs": "line:int,n_body:int,n_else:int,last:string,else_if:boolean,body_hash:string,else_hash:string",
    "handlers": "line:int,type_name:string,silent:boolean",
    "writes": "func:int,name:string,line:int,target:string,via:string,guarded:boolean,first:boolean",
    "literals": "line:int,display:string,value:string,is_int:boolean",
    "compares": "line:int,value:string,excluded:boolean,times:int",
    "privates": "line:int,form:string,attr:string,allowed:boolean",
    "chains": "stmt:int,line:int,depth:int,root:string,imported:boolean",
    "assigns": "line:int,name:string,is_mutable:boolean",
    "hashes": "line:int,text:string",
    "twins": "name:string,other:string,class_name:string,line:int,ratio:double,place:int",
}
FACTS = (
    "package string, root string, path string, rel_path string, module string, is_test boolean, is_init boolean, parts array<string>, n_lines int, parse_error string, "
    "lines array<string>, used array<string>, dead array<int>, dicts array<int>, edges array<string>, "
    + ", ".join(f"{k} array<struct<{v}>>" for k, v in FAMILIES.items())
)
ISSUE = "struct<line:int,severity:string,rule:string,message:string,rule_no:int,pos:int>"
