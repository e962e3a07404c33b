"""Schemas of a book's nested form."""

BLOCK = "struct<type:string,id:string,page:int,role:string,include:boolean,level:int,label:string,title:string,text:string,lines:array<string>,verse:boolean,epigraph:boolean,attribution:boolean,notes:map<string,string>,data:string,width:int,height:int>"
BOOK = f"struct<version:int,metadata:struct<title:string,author:string,language:string,identifier:string>,blocks:array<{BLOCK}>,notes:array<string>,include_notes:boolean,cover:string,cover_source:string>"
