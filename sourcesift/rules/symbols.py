"""Short names that minified builds use, by framework, and the names they stand for.

Fixed values in this file: they decide which calls are recognised. The tables of the two frameworks that every text is
searched for are whole; the others are short defaults. A full table for them is long and belongs to a build,
so it is a parameter: see ``normalise.read_symbols``.
"""

from __future__ import annotations

ANGULAR = {
    "j41": "ɵɵelementStart", "k0s": "ɵɵelementEnd", "nrm": "ɵɵelement", "Hgh": "ɵɵelementContainer",
    "Hqn": "ɵɵelementContainerEnd", "ncO": "ɵɵprojectionDef", "aNF": "ɵɵprojection", "SdG": "ɵɵprojectionImpl",
    "NAR": "ɵɵdeclareProjDef", "rj2": "ɵɵelementStartNS", "eux": "ɵɵnamespacedElementEnd", "qSk": "ɵɵnamespaceSVG",
    "joV": "ɵɵnamespaceHTML", "bIt": "ɵɵlistener", "mxI": "ɵɵtwoWayListener", "tSv": "ɵɵsyntheticHostListener",
    "Z7z": "ɵɵrepeaterTrackBy", "EFF": "ɵɵtext", "JRh": "ɵɵtextInterpolate1", "SpI": "ɵɵtextInterpolate2",
    "Lme": "ɵɵtextInterpolate4", "LHq": "ɵɵtextInterpolate8", "ai1": "ɵɵtextInterpolateV",
    "DH7": "ɵɵtextInterpolateV", "Y8G": "ɵɵproperty", "R50": "ɵɵtwoWayProperty", "BMQ": "ɵɵattribute",
    "MHs": "ɵɵattribute", "MHn": "ɵɵattributeInterpolate", "THe": "ɵɵpropertyInterpolate", "jOp": "ɵɵhostProperty",
    "xc7": "ɵɵstylePropInterpolate1", "AVh": "ɵɵclassProp", "HbH": "ɵɵclassMap", "KoU": "ɵɵclassMap",
    "sMw": "ɵɵclassMapInterpolate1", "sbH": "ɵɵstyleProp", "d8G": "ɵɵstyleMap", "VkB": "ɵɵstyleMapInterpolate1",
    "Udp": "ɵɵupdateBinding", "nVh": "ɵɵtemplate", "vxM": "ɵɵconditional", "vZN": "ɵɵconditionalWithMemo",
    "Dyx": "ɵɵrepeaterApply", "BUC": "ɵɵrepeaterCreate", "qex": "ɵɵdeferredBlockStart", "bVm": "ɵɵdeferredBlockEnd",
    "DNE": "ɵɵdeferredBlockSlot", "R7$": "ɵɵadvance", "RV6": "ɵɵgetCurrentView", "XpG": "ɵɵnextContext",
    "eBV": "ɵɵrestoreView", "Njj": "ɵɵresetView", "sdS": "ɵɵgetDirectives", "fX1": "ɵɵtemplateRefExtractor",
    "wD4": "ɵɵtemplateContext", "nI1": "ɵɵpipe", "bMT": "ɵɵpipeBind2", "Xts": "ɵɵpipeBind", "x7i": "ɵɵpipeBindV",
    "mI1": "ɵɵpipeBindV", "i5U": "ɵɵpipeBind4", "l_i": "ɵɵpipeBind3", "lJ4": "ɵɵpipeBindV", "eq3": "ɵɵi18nExp",
    "GBs": "ɵɵviewQuery", "lsd": "ɵɵloadQueryList", "mGM": "ɵɵqueryRefresh", "npT": "ɵɵsanitizeHtml",
    "mNQ": "ɵɵsanitizeHtml2", "P7a": "ɵɵsanitizeUrl", "scb": "ɵɵsanitizeResourceUrl", "yYe": "ɵɵsanitizeScript",
    "nln": "ɵɵsanitizeStyle", "B4B": "ɵɵtrustHtml", "GfV": "ɵɵtrustResourceUrl", "ZxD": "ɵɵtrustScript",
    "KVd": "ɵɵtrustUrl", "lnJ": "ɵɵi18n", "f6r": "ɵɵi18nApply", "mI1x": "ɵɵi18nAttributes",
    "VBU": "ɵɵdefineComponent", "VB$": "ɵɵdefineComponent2", "jDH": "ɵɵdefineInjectable", "tiK": "ɵɵdefineNgModule",
    "hqG": "ɵɵsetNgModuleScope", "bmF": "ɵɵdefineDirective", "jtY": "ɵɵdefinePipe", "EJ8": "ɵɵdefinePipe",
    "WQX": "ɵɵinject", "Mgp": "ɵɵinjectAttribute", "lFW": "ɵɵinjectImplementation",
    "wRn": "ɵɵrunInInjectionContext", "rCR": "ɵɵresetCompiledComponents", "xGo": "ɵɵgetFactory",
    "oKB": "ɵɵimportProvidersFrom", "Jv_": "ɵɵproviders", "Rfq": "ɵɵforwardRef", "SKi": "NgZone",
    "OA$": "ɵɵNgOnChangesFeature", "Vt3": "ɵɵInheritDefinitionFeature", "kB": "ɵɵCopyDefinitionFeature",
}
RXJS = {
    "b.T": "map", "b.t": "mapTo", "g.W": "catchError", "g.w": "catchError", "g.M": "mergeMap", "g.S": "switchMap",
    "g.E": "exhaustMap", "g.F": "flatMap", "g.c": "concatMap", "g.f": "filter", "g.d": "debounceTime", "g.t": "tap",
    "g.D": "distinctUntilChanged", "g.T": "take", "xt.p": "combineLatest", "xt.A": "forkJoin", "rd.z": "zip",
    "yt.of": "of", "gm.H": "from", "Vc.c": "Observable", "St.w": "EMPTY", "Zt.B": "BehaviorSubject",
}
SYMBOLS = {
    "angular": ANGULAR,
    "rxjs": RXJS,
    "vue": {"cEV": "createElementVNode", "cTV": "createTextVNode", "cEB": "createElementBlock", "oB": "openBlock",
        "rL": "renderList", "oMt": "onMounted", "dC": "defineComponent", "nxt": "nextTick"},
    "react": {"uSt": "useState", "uEf": "useEffect", "uCb": "useCallback", "uMm": "useMemo", "uRf": "useRef",
        "uCx": "useContext", "cRt": "createRoot", "rnd": "render", "oCh": "onChange"},
    "svelte": {"ins": "insert", "nod": "noop", "mntC": "mount_component", "dstC": "destroy_component",
        "cIfB": "create_if_block", "wrt": "writable"},
    "nextjs": {"uPN": "usePathname", "uSP": "useSearchParams", "rdr": "redirect", "nNA": "notFound"},
    "lodash": {"fnd": "_.find", "grB": "_.groupBy", "srtB": "_.sortBy", "clnD": "_.cloneDeep", "dbc": "_.debounce"},
    "date-fns": {"prsI": "parseISO", "fmtI": "formatISO", "addD": "addDays", "dffD": "differenceInDays"},
    "zod": {"zO": "z.object", "zS": "z.string", "zN": "z.number", "zA": "z.array"},
    "zustand": {"crtSt": "createStore", "uSt": "useStore", "prst": "persist"},
    "immer": {"cDft": "createDraft", "fnDft": "finishDraft", "apPt": "applyPatches"},
}
